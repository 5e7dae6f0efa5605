"""Header-less readers for explicit ratings and implicit feedback.

One pass over text lines: exactly four comma-separated fields without blanks,
each of its type; anything else (a header line, other arity, an empty field, a
number out of range) fails with the file, the line's text and what was expected.
The check is a filter on the line, so no query can prune it: ``count()`` fails
like ``collect()``.  Kept differences from a plain ``split(',')`` parser: blank
lines are skipped; a trailing comma (a fifth, empty field) is rejected.

``seq`` is the position in file order: ``monotonically_increasing_id``
grows with the byte offset inside a file and with the file listing order,
so it is a valid order key (not dense; use ``global_index`` for 0..n-1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorcast.functions.vectors import code_to_rating

RATINGS_FIELDS = {"user": "int", "product": "int", "rating": "float", "timestamp": "int"}
FEEDBACK_FIELDS = {"code": "string", "user": "int", "product": "int", "timestamp": "long"}


def parse_lines(lines: DataFrame, fields: dict[str, str], file: Column) -> DataFrame:
    """(seq, *fields) of text lines (column ``value``); ``file`` names
    the source in errors."""
    parts = F.split("value", ",")
    typed = {c: parts.getItem(i).try_cast(t) for i, (c, t) in enumerate(fields.items())}
    good = (F.size(parts) == len(fields)) & ~F.col("value").rlike(r"\s")
    for i, c in enumerate(fields):
        good = good & F.coalesce(typed[c].isNotNull() & (parts.getItem(i) != ""), F.lit(False))
    fail = F.raise_error(F.concat(
        F.lit("malformed line in "), file, F.lit(": '"), F.col("value"),
        F.lit(f"', expected {','.join(f'{c} {t}' for c, t in fields.items())}"))).cast("boolean")
    return lines.where(F.col("value") != "").where(
        F.when(good, F.lit(True)).otherwise(fail)).select(
        F.monotonically_increasing_id().alias("seq"), *[typed[c].alias(c) for c in fields])


def _read(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines, fields, F.col("file"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: ``user,product,rating,timestamp`` -> (seq, user, product, rating, timestamp)."""
    return _read(spark, path, RATINGS_FIELDS)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: ``code,user,product,timestamp`` (note the column order) ->
    (seq, user, product, rating, timestamp) with rating 1.0 for code G."""
    return _read(spark, path, FEEDBACK_FIELDS).select(
        "seq", "user", "product", code_to_rating("code").alias("rating"), "timestamp")


def write_ratings(df: DataFrame, path: str) -> None:
    """Inverse of SRC1 (used to stage derived tables as CSV)."""
    (df.select(F.col("user").cast("int"), F.col("product").cast("int"),
               F.col("rating").cast("float"), F.col("timestamp").cast("int"))
       .write.mode("overwrite").option("header", "false").csv(path))


def write_feedback(df: DataFrame, path: str) -> None:
    (df.select("code", F.col("user").cast("int"), F.col("product").cast("int"),
               F.col("timestamp").cast("long"))
       .write.mode("overwrite").option("header", "false").csv(path))
