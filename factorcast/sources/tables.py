"""Feedback tables derived from the warehouse tables.

``ratings``  (explicit): one row per line item, the buyer rates the part.
``feedback`` (implicit): one row per event; purchase/click is positive.

Both carry the columns of a unique order key, so every protocol that
treats "order as the clock" can build a global index (W1) from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorcast.functions.vectors import code_to_rating

# Order keys (unique per row) and hash keys for the hold-out split.
RATINGS_ORDER = ["ts", "okey", "line", "product", "supp"]
RATINGS_HASH_KEY = ["okey", "line", "product", "supp"]
FEEDBACK_ORDER = ["ts", "seq"]
FEEDBACK_HASH_KEY = ["seq"]

POSITIVE_EVENT_TYPES = ("purchase", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, product, rating, ts, okey, line, supp).

    rating = ceil(quantity / 5) / 2, i.e. 0.5 .. 5.0 in half steps."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("product"),
        (F.ceil(F.col("l_quantity") / F.lit(5.0)).cast("double") / F.lit(2.0)).alias("rating"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, user, product, code, rating, ts) from ``events``."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "props", "ts")
    code = F.when(F.col("event_type").isin(*POSITIVE_EVENT_TYPES), F.lit("G")).otherwise(F.lit("N"))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("product"),
        code.alias("code"),
        code_to_rating(code).alias("rating"),
        F.col("ts"),
    )
