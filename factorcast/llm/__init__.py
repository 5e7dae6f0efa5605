"""Training-data operators: tokenisation, archives, filtering, near-duplicate
detection, mixing, sharding, scoring, clustering and filter audits for corpora of
text documents.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``corpus_pipeline.py`` (repository top) chains five operators.
"""
