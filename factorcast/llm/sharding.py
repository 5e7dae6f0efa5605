"""Operator 10: shards from sampled splitters.

Rows are keyed by (hash of the text, id), so equal texts lie side by side.
A sample whose odds grow with the rows' sizes gives splitters at its
quantiles; rows are dealt to the ranges between them, and a range that
turns out overfull (in bytes or rows) is sampled and subdivided again, down
to single ids within one hot text.  Running sums inside the bounded ranges
plus the ranges' totals place every row in the whole order; shard borders
are cut there by the law.

Laws: ``bytes`` - sizes near equal; a group of equal texts of at most
``keep_share`` of a shard stays whole, a larger one is cut between rows;
``rows`` - counts at most one apart (groups may be cut); ``key`` - the id and
the number of shards alone decide (rendezvous hashing), so one more shard
takes rows only into itself.

Defined results: null texts have size 1 and the CRC of the empty text; rows
that repeat an id and text are ordered arbitrarily among themselves and get
different slots.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorcast.llm.common import materialize, uniform

FINE = 16             # ranges per shard
SAMPLES = 32          # expected sample rows per range; the sample is FINE * shards * SAMPLES
OVERFULL = 2.0        # a range is overfull beyond this multiple of its fair share


def _below(splitters: list[tuple[int, str]]) -> Column:
    """Number of splitters at or below the row's key: its range."""
    if not splitters:
        return F.lit(0)
    key = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"))
    at = F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(k).alias("k"))
                   for h, k in splitters])
    return F.size(F.filter(at, lambda s: s <= key))


def sampled_ranges(rows: DataFrame, n_ranges: int, total: float) -> tuple[DataFrame, int]:
    """``rows`` (_h, _k, _u, _w) with their range ``_range``, none overfull
    unless it is one id.  The driver sees samples and one row per range."""
    share = total / n_ranges
    splitters: list[tuple[int, str]] = []
    over: list[int] | None = None
    ranged = rows.withColumn("_range", F.lit(0))
    for round_ in count():              # until no range is overfull, or none can be cut
        pool = ranged if over is None else ranged.where(F.col("_range").isin(over))
        odds = F.least(F.lit(1.0), F.col("_w") * (SAMPLES / share))
        # range -> sampled keys, each standing for w / odds
        drawn = pool.where(uniform(F.col("_u"), f"shard{round_}") < odds).select(
            "_range", "_h", "_k", (F.col("_w") / odds).alias("weight")).collect()
        added = set()
        by_range: dict[int, list] = {}
        for r in drawn:
            by_range.setdefault(r["_range"], []).append((r["_h"], r["_k"], r["weight"]))
        for keys in by_range.values():
            keys.sort()
            of_hash: dict[int, float] = {}
            for h, _, w in keys:
                of_hash[h] = of_hash.get(h, 0.0) + w
            since = 0.0
            for h, k, w in keys:
                since += w
                hot = of_hash[h] > share
                if hot:     # a text alone above a fair share: its own ranges, cut between rows
                    added |= {(h, ""), (min(h + 1, 2 ** 63 - 1), "")}
                if since >= share:
                    added.add((h, k) if hot else (h, ""))
                    since = 0.0
        if not added - set(splitters):
            break
        splitters = sorted(set(splitters) | added)
        ranged = rows.withColumn("_range", _below(splitters))
        weights = ranged.groupBy("_range").agg(
            F.sum("_w").alias("w"), F.min("_k").alias("a"), F.max("_k").alias("b")).where(
            f"w > {OVERFULL * share} and a <> b").collect()
        over = [r["_range"] for r in weights]
        if not over:
            break
    return ranged, len(splitters) + 1


def rendezvous(id_col: Column, shards: int) -> Column:
    """The shard whose hash with the id is greatest."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
        F.xxhash64(F.lit("shard"), s, id_col).alias("h"), s.alias("s")))
    return F.array_max(marks)["s"].cast("int")


def shard(docs: DataFrame, shards: int = 16, law: str = "bytes", id_col: str = "doc_id",
          text_col: str = "text", keep_share: float = 0.01) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard)."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"law {law!r}")
    text = F.col(text_col).cast("string")
    base = materialize(docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_u")))
    base = base.withColumn("_k", F.concat(
        F.coalesce(F.lpad(F.col("_id").cast("string"), 20, "0"), F.lit("")), F.lit(":"),
        F.lpad(F.col("_u").cast("string"), 20, "0")))
    n, bytes_ = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    none = F.lit(None).cast("int")
    if law == "key" or n == 0:
        base = base.withColumn("shard", rendezvous(F.col("_id"), shards)).withColumn(
            "grown_shard", rendezvous(F.col("_id"), shards + 1) if law == "key" else none)
    else:
        base = base.withColumn("grown_shard", none)
    # a range is bounded in bytes and in rows: the weight is half of each
    weighed = base.withColumn("_w", F.col("size") / (2.0 * max(1, bytes_))
                              + F.lit(1 / (2.0 * max(1, n))))
    ranged, n_ranges = sampled_ranges(weighed, shards * FINE, 1.0)
    ranged = materialize(ranged)
    inside = Window.partitionBy("_range").orderBy("_h", "_k")
    tail = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_range", "_h")
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if law == "key" or n == 0:
        # slots: per (shard, range) totals, then the place inside
        inside = Window.partitionBy("_range", "shard").orderBy("_h", "_k")
        part = ranged.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
        before = part.withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy("shard").orderBy("_range").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        out = ranged.join(F.broadcast(before), ["shard", "_range"]).withColumn(
            "slot", F.col("_before") + F.row_number().over(inside) - 1)
    else:
        totals = ranged.groupBy("_range").agg(F.sum("size").alias("_b"),
                                              F.count(F.lit(1)).alias("_n"))
        before = totals.select("_range", *[
            F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}0") for c in ("_b", "_n")])
        placed = ranged.join(F.broadcast(before), "_range").withColumn(
            "_row", F.col("_n0") + F.row_number().over(inside) - 1).withColumn(
            "_at", F.col("_b0") + F.coalesce(F.sum("size").over(tail), F.lit(0)))
        if law == "rows":
            number = F.expr(f"cast(_row * {shards} div {n} as int)")
        else:
            placed = placed.withColumn("_group", F.sum("size").over(group)).withColumn(
                "_first", F.min("_at").over(group))
            small = F.col("_group") <= keep_share * bytes_ / shards
            middle = F.when(small, F.col("_first") * 2 + F.col("_group")).otherwise(
                F.col("_at") * 2 + F.col("size"))
            number = F.least(F.lit(shards - 1), F.floor(
                middle.cast("decimal(38,0)") * shards / (2 * bytes_)).cast("int"))
        placed = materialize(placed.withColumn("shard", number.cast("int")))
        starts = placed.groupBy("shard").agg(F.min("_row").alias("_row0"))
        out = placed.join(F.broadcast(starts), "shard").withColumn(
            "slot", F.col("_row") - F.col("_row0"))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"),
                      F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
