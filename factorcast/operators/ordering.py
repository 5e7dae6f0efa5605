"""Order-as-clock operators: global index, time blocks, slices, hash split.

No operator here uses an unpartitioned window over the data: the global
index is a range partition + per-partition offsets, per-key running
counts are two-level (chunk totals, then within-chunk windows), so one
hot user or one hot day never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorcast import config
from factorcast.session import materialize

# Prime modulus and multipliers of the arithmetic split hash.  Chosen so
# every intermediate stays below 2^63 for non-negative BIGINT keys, which
# lets an ANSI SQL engine compute the identical value.
HASH_PRIME = 2147483647
HASH_STEP = 1000003
HASH_MIX = 48271
HASH_BUCKETS = 10000

DEFAULT_CHUNK_ROWS = 1 << 20


def global_index(df: DataFrame, order_cols: list[str], idx: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order.

    ``order_cols`` must be unique per row (ties would make positions
    depend on the partition layout).  Rows are range-partitioned on
    the full key (so a hot prefix such as one busy day is split across
    partitions), sorted inside each partition, tagged with their local
    position, materialized once, and shifted by the exact row count of
    all earlier partitions (a table with one row per partition)."""
    # without an explicit count AQE may merge adjacent ranges to its target
    # partition size; merged ranges stay contiguous, so the order holds
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols)).sortWithinPartitions(*order_cols)
    tagged = materialize(ranged.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id()
         - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_pos"),
    ))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, safe to order globally and broadcast
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(idx, (F.col("_off") + F.col("_pos")).cast("long")).drop(
        "_pid", "_pos", "_off")


def block_edge(n_rows: int, i, n_blocks: int = config.N_BLOCKS) -> Column:
    """edge(i) = floor(n / n_blocks * i) in double arithmetic (may be n-1
    for i = n_blocks, which then drops the last row, as the original)."""
    i = i if isinstance(i, Column) else F.lit(i)
    per = F.lit(float(n_rows)) / F.lit(float(n_blocks))
    return F.floor(per * i.cast("double")).cast("long")


def time_blocks(df: DataFrame, n_rows: int, idx: str = "idx",
                n_blocks: int = config.N_BLOCKS, out: str = "block") -> DataFrame:
    """Block number of each row, blocks [edge(b), edge(b+1)).

    Computed arithmetically (no join): the block is the largest b with
    edge(b) <= idx, i.e. ceil((idx + 1) * n_blocks / n) - 1 (exact when
    blocks are empty, n < n_blocks), corrected by one step against the
    exact double-arithmetic edges.  Rows beyond edge(n_blocks) get NULL."""
    i = F.col(idx)
    guess = F.least(F.greatest(
        F.ceil((i + 1).cast("double") * float(n_blocks) / float(max(n_rows, 1))).cast("long") - 1,
        F.lit(0)), F.lit(n_blocks - 1))
    up = F.when(block_edge(n_rows, guess + 1, n_blocks) <= i, guess + 1)
    down = F.when(block_edge(n_rows, guess, n_blocks) > i, guess - 1)
    b = F.coalesce(up, down, guess)
    valid = (i >= 0) & (i < block_edge(n_rows, n_blocks, n_blocks))
    return df.withColumn(out, F.when(valid, b).cast("long"))


def block_bounds(spark, n_rows: int, n_blocks: int = config.N_BLOCKS) -> DataFrame:
    """The edges as a small (block, lo, hi) table (n_blocks rows)."""
    b = spark.range(n_blocks).select(F.col("id").alias("block"))
    return b.select("block",
                    block_edge(n_rows, F.col("block"), n_blocks).alias("lo"),
                    block_edge(n_rows, F.col("block") + 1, n_blocks).alias("hi"))


def slice_rows(df: DataFrame, lo: int, hi: int, idx: str = "idx") -> DataFrame:
    """Rows with lo <= idx < hi (pushed down as a range filter)."""
    return df.where((F.col(idx) >= lo) & (F.col(idx) < hi))


def row_hash(key_cols: list, seed: int = config.SEED) -> Column:
    """Deterministic, layout-independent hash in [0, HASH_PRIME): a
    polynomial over the key columns mod a prime, then one multiplicative
    mixing step.  Every intermediate fits a BIGINT, so SQL engines agree."""
    h = F.lit(seed % HASH_PRIME).cast("long")
    for c in key_cols:
        c = F.col(c) if isinstance(c, str) else c
        h = F.pmod(h * HASH_STEP + F.pmod(c.cast("long"), F.lit(HASH_PRIME)), F.lit(HASH_PRIME))
    return F.pmod(h * HASH_MIX, F.lit(HASH_PRIME))


def split_hash(key_cols: list[str], seed: int = config.SEED) -> Column:
    """Deterministic, layout-independent bucket in [0, HASH_BUCKETS)."""
    return F.pmod(row_hash(key_cols, seed), F.lit(HASH_BUCKETS))


def holdout_split(df: DataFrame, key_cols: list[str], seed: int = config.SEED,
                  train_fraction: float = config.TRAIN_FRACTION,
                  out: str = "is_train") -> DataFrame:
    """SP1: Bernoulli-like train/test flag from a hash of the row key, so
    membership does not depend on partitioning."""
    cut = int(round(train_fraction * HASH_BUCKETS))
    return df.withColumn(out, split_hash(key_cols, seed) < cut)


def shuffle_key(row_cols: list[str], seed: int, epoch) -> Column:
    """A fresh pseudo-random visiting order per epoch (seeded,
    reproducible, independent of partitioning); ties, if any, are broken
    by the row columns."""
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return row_hash([epoch] + list(row_cols), seed)


def rebalance(df: DataFrame, n: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """SP2: spread rows evenly over ``n`` partitions (by key when given)."""
    n = n or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *cols) if cols else df.repartition(n)


def counts_before(df: DataFrame, part: str, idx: str, flags: dict[str, str], inclusive: bool = False,
                  totals: dict[str, str] | None = None,
                  chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per-key running counts: for each ``out: flag`` of ``flags`` the sum of
    the flag over the key's rows with a smaller ``idx`` (``inclusive``: and
    this one); for each ``out: flag`` of ``totals`` its sum over all the
    key's rows.

    One two-level scan for all flags: rows are dealt once by (key, idx //
    chunk_rows); chunk totals are prefix-summed per key (a table of at most
    one row per chunk), then one window inside each (key, chunk) adds the
    local counts.  A key holding a third of all rows is spread over many
    chunk tasks."""
    totals = totals or {}
    names = list(dict.fromkeys([*flags.values(), *totals.values()]))
    value = {c: f"_v{i}" for i, c in enumerate(names)}
    d = df.withColumn("_chunk", F.floor(F.col(idx) / F.lit(chunk_rows)).cast("long")).withColumns(
        {v: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c, v in value.items()}
    ).repartition(part, "_chunk")
    sums = d.groupBy(part, "_chunk").agg(*[F.sum(v).alias(v) for v in value.values()])
    of_key = Window.partitionBy(part)
    offsets = sums.select(
        part, "_chunk",
        *[(F.sum(v).over(of_key.orderBy("_chunk")) - F.col(v)).alias(f"_off{v}") for v in value.values()],
        *[F.sum(value[c]).over(of_key).cast("long").alias(out) for out, c in totals.items()])
    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy(part, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    counted = {out: (F.col(f"_off{value[c]}") + F.coalesce(F.sum(value[c]).over(within), F.lit(0))).cast("long")
               for out, c in flags.items()}
    return d.join(offsets, [part, "_chunk"]).withColumns(counted).drop(
        "_chunk", *value.values(), *[f"_off{v}" for v in value.values()])


def count_before(df: DataFrame, part: str, idx: str, flag: str, out: str,
                 inclusive: bool = False,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``counts_before`` of one flag."""
    return counts_before(df, part, idx, {out: flag}, inclusive, chunk_rows=chunk_rows)
