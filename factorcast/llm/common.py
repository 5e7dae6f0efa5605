"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorcast.session import ensure_checkpoint_dir, materialize

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are
# fewer than HOT_SHARE hot keys whatever the data: a table of them may be broadcast.
HOT_SHARE = 1000
HOT_SPREAD = 1 << 20

__all__ = ["HOT_SHARE", "components", "fresh", "lookup", "materialize",
           "pieces", "prefix_sums", "scratch_path", "table", "uniform"]


def pieces(batches: Iterator[pa.Array], rows: int = 1000) -> Iterator[pa.Array]:
    """Arrow batches cut into pieces of at most ``rows`` rows, so that a
    function over texts holds few of them as Python objects at a time."""
    for batch in batches:
        n = batch.num_rows if isinstance(batch, pa.RecordBatch) else len(batch)
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, i = f"_{stem}", 0
    while name.lower() in taken:
        i += 1
        name = f"_{stem}_{i}"
    return name


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A new folder name below the cluster's checkpoint folder (shared by all
    executors); each call gives another, so a rerun never meets old files."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def uniform(col: Column, seed: str) -> Column:
    """A number in [0, 1) that depends only on ``col`` and ``seed``."""
    return (F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 52)) / F.lit(float(1 << 52)))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, spread_by: str,
           n_col: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``keyed`` (one row per ``key``; ``n_col`` is
    the number of rows that have it, ``total`` their sum).

    Hot keys are joined by broadcast, the table of them having fewer than
    HOT_SHARE rows; their rows then go through the shuffle join under a
    spread key that matches nothing, so no task gets a whole hot key.
    Columns of ``keyed`` other than ``key`` and ``n_col`` are added."""
    values = [c for c in keyed.columns if c not in (key, n_col)]
    packed = F.struct(*values)
    hot = keyed.where(F.col(n_col) * HOT_SHARE > total).select(key, packed.alias("_hot"))
    cold = keyed.where(F.col(n_col) * HOT_SHARE <= total).select(
        # always 0, but no literal: that would let the planner deal rows by the key alone
        key, F.least(F.col(n_col), F.lit(0)).cast("int").alias("_spread"), packed.alias("_cold"))
    joined = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
            (F.pmod(F.xxhash64(spread_by), F.lit(HOT_SPREAD)) + 1).cast("int")))
    joined = joined.join(cold, [key, "_spread"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])


def prefix_sums(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that come before this
    one in ``order`` (unique per row).  Rows are range-partitioned on the
    whole order key, so a hot leading key spreads over many tasks; the only
    table that is not partitioned has one row per partition."""
    window = Window.partitionBy("_pid").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    ranged = materialize(rows.repartitionByRange(*order)
                         .withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    before = sums.select("_pid", F.coalesce(F.sum("_sum").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_pid").withColumn(
        out, F.col("_before") + F.coalesce(F.sum(value).over(window), F.lit(0))
    ).drop("_pid", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component = smallest node) of every node
    of ``edges`` (a, b).

    Alternating large-star and small-star rounds: every step replaces links
    by links to the smallest neighbour, so the table never grows beyond the
    number of links, and the rounds are logarithmic in it.  A hub's links
    are spread by :func:`lookup`; minima are pre-aggregated before the
    shuffle.  Each round ends in a reliable checkpoint."""
    def star(links: DataFrame, large: bool, total: int) -> DataFrame:
        """Links as (u, v): large: each greater neighbour of u to the least
        of u and its neighbours; small: the lesser ones and u to the least."""
        least = materialize(links.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        near = lookup(links, least, "u", "v", "n", total)
        if large:
            return near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.where("u <> m").select(
            F.col("u").alias("a"), F.col("m").alias("b")))

    def state(links: DataFrame):
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
                               ).first())

    edges = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = star(both, True, 2 * seen[0]).where("a <> b").distinct()
        down = materialize(big.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        edges = materialize(star(down, False, seen[0]).where("a <> b").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
