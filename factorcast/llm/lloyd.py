"""Operator 12: Lloyd's k-means sharded by dimension, in exact integers.

Vectors become integers and are cut into blocks of columns.  A block of some of
the vectors is one shard; shards are placed once, by (block, bucket of vectors),
and stay there.  A round is one job:

1. every shard gives the exact partial squared distances of its vectors to the
   centroids' slices of its columns;
2. the partials are added by vector (reduce by key) and the least one wins, the
   smaller centroid number on ties;
3. the assignments go back to the shards, which add up their own columns by
   cluster (partial and final aggregation); each slice of a new centroid is the
   componentwise floor of sum / count, and an empty centroid stays.

Only the centroids (k x dims integers) pass through the driver.  Lineage does not
grow: every round starts from the checkpointed shards.

Defined results: vectors that are null, have another number of components, or hold
a null, non-finite or huge component (beyond +-2^27 after scaling, where a squared
distance might not fit a long) are left out.  Rows that repeat an id, and rows with a
null id (hashed as an empty text), are vectors of their own; the start order breaks
equal hashes by components.  With fewer vectors than k there are fewer centroids, and
none of an empty table, which gives no rows.  Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import materialize

LARGEST = 1 << 27
BLOCK = 16              # columns of a block


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(row, id, x): the kept vectors, each component floor(scale * x); ``row``
    numbers the rows of the checkpointed table."""
    e = F.col(vec_col).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale > LARGEST))
    kept = vectors.where((F.size(e) == dims) & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.transform(e, lambda x: F.floor(x * scale).cast("int")).alias("x"))
    return materialize(kept)


def start(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed + id, as a matrix."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
                    .cast("binary"), 256)
    picked = rows.orderBy(digest, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in picked], np.int64)


def shards(rows: DataFrame, dims: int, block: int) -> DataFrame:
    """(block, bucket, row, x): one row a vector and block of columns, placed by
    (block, bucket) and checkpointed with that placement."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-dims // block)
    buckets = max(1, -(-n // blocks))
    cut = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(
        b.alias("block"), F.slice("x", b * block + 1, F.lit(block)).alias("x")))
    return materialize(
        rows.select("row", F.explode(cut).alias("s")).select(
            "s.block", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"),
            "row", "s.x").repartition(blocks * buckets, "block", "bucket")
        .sortWithinPartitions("block", "bucket", "row"), keep_partitioning=True)


def assign(placed: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """(row, bucket, cluster, distance) of every vector."""
    k = len(centroids)
    names = [f"d{i}" for i in range(k)]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x = batch.column(0).to_numpy(), batch.column(3)
            flat, ends = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            for b in np.unique(of):
                at = np.flatnonzero(of == b)
                part = centroids[:, b * block:(b + 1) * block]
                mine = flat[ends[at][:, None] + np.arange(part.shape[1])].astype(np.int64)
                sums = np.stack([((mine - c) ** 2).sum(axis=1) for c in part])
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(taken), batch.column(1).take(taken),
                     *[pa.array(s) for s in sums]], ["row", "bucket", *names])

    added = placed.mapInArrow(partials, "row long, bucket int, " + ", ".join(
        f"{d} long" for d in names)).groupBy("row", "bucket").agg(
        *[F.sum(d).alias(d) for d in names])
    least = F.least(*names) if k > 1 else F.col("d0")
    return added.select("row", "bucket", (F.array_position(F.array(*names), least) - 1)
                        .cast("int").alias("cluster"), least.alias("distance"))


def update(placed: DataFrame, assigned: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """New centroids: each shard adds up its own columns by cluster."""
    blocks = -(-centroids.shape[1] // block)
    back = assigned.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "bucket", "row", "cluster")
    sums = placed.join(back, ["block", "bucket", "row"]).groupBy("block", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(block)])
    mean = F.array(*[F.expr(f"(s{j} - pmod(s{j}, n)) div n") for j in range(block)])
    new = centroids.copy()
    for r in sums.select("block", "cluster", mean.alias("x")).collect():    # blocks x k rows
        cut = new[r["cluster"], r["block"] * block:(r["block"] + 1) * block]
        cut[:] = r["x"][:len(cut)]
    return new


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, seed: str, scale: int = 1024,
            id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): ``centroid``
    is the final centroid of the vector's cluster as an array."""
    rows = quantised(vectors, id_col, vec_col, dims, scale)
    centroids = start(rows, k, seed)
    if not len(centroids):
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"),
            *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.col("x").cast("array<long>").alias("centroid"))
    placed = shards(rows, dims, block)
    for _ in range(rounds):
        centroids = update(placed, assign(placed, centroids, block), centroids, block)
    final = materialize(assign(placed, centroids, block).drop("bucket"))
    total = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(
        F.sum("distance").alias("s")).collect()}                             # at most k rows
    spark = vectors.sparkSession
    summary = spark.createDataFrame(
        [(i, total.get(i, 0), sum(total.values()), c.tolist()) for i, c in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.select("row", F.col("id").alias(id_col)).join(final, "row").join(
        F.broadcast(summary), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
