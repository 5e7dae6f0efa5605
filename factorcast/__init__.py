"""Spark-native latent-factor recommender toolkit."""
