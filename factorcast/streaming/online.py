"""Structured Streaming forms of the online loops.

ST1 ``stream_prequential``  score each micro-batch with factor version N,
                            append its metrics, learn it, write version N+1.
ST2 ``stream_last_k``       per-user K newest ratings as keyed state, a value a
                            bucket of users (``transformWithStateInPandas``,
                            RocksDB store).
ST3 ``stream_recommend``    learn each micro-batch, then refresh the top R
                            for the users it touched.

Exactly-once by construction: every output of batch N (metrics partition,
factor version N+1, recommendation partition) is a deterministic function
of version N and the batch rows and is written with overwrite semantics,
so a batch replayed after a failure rewrites identical files.  A batch reads
the vectors of its own users and products and writes the ones it changed, as a
delta of a versioned table (``sources.store``), which drops old versions.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.util import inheritable_thread_target

from factorcast import config
from factorcast.operators.recommend import recommend_top_r
from factorcast.operators.train import (BUFFER_ROWS, combine_factors, empty_factors, online_update,
                                        score_and_learn, split_factors)
from factorcast.session import broadcast_if_fits, materialize
from factorcast.sources.sinks import scratch_path
from factorcast.sources.store import VersionedTable, factor_store

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


FILES = 4                 # files of a micro-batch, written by as many tasks


def stage_stream(df: DataFrame, idx: str, bounds: list[tuple[int, int]], root: str) -> str:
    """Write FILES Parquet files per micro-batch, with file modification times
    that follow the stream order (the file source consumes oldest first).
    ``idx`` is gapless, so every file of a batch of at least FILES rows has
    rows; only the last batch may be smaller.  ``bounds`` ascend.

    ``df`` is read once and all batches are written by one job; their times are
    set afterwards.  A file system that keeps no set times gets the batches
    written again, one after the other."""
    spark = df.sparkSession
    lows, highs = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.arrow_udf("int")
    def number(positions: pa.Array) -> pa.Array:
        at = pc.fill_null(positions, -1).to_numpy(zero_copy_only=False)
        j = np.searchsorted(lows, at, side="right") - 1
        within = positions.is_valid().to_numpy(zero_copy_only=False) & (j >= 0) & (at < highs[j])
        return pa.array(j.astype(np.int32), mask=~within)

    if not bounds:
        return root
    path = scratch_path(spark, "stream-batches")
    numbered = df.withColumn("_batch", number(F.col(idx).cast("long"))).where("_batch IS NOT NULL")
    # all files of a batch from FILES tasks, whatever the number of tasks
    wide = max(1, 2 * spark.sparkContext.defaultParallelism // FILES)
    task = F.pmod(F.col(idx), F.lit(FILES)) + F.lit(FILES) * F.pmod(F.col("_batch"), F.lit(wide))
    (numbered.repartitionById(FILES * wide, task.cast("int")).sortWithinPartitions("_batch")
     .write.partitionBy("_batch").option("maxRecordsPerFile", 0).parquet(path))
    if not _file_in_order(spark, path, root, len(bounds)):
        staged = spark.read.schema(numbered.schema).parquet(path)
        for j in range(len(bounds)):
            part = staged.where(F.col("_batch") == j).select(*df.columns)
            part.repartitionById(FILES, F.pmod(F.col(idx), F.lit(FILES)).cast("int")).write.mode(
                "overwrite").parquet(f"{root}/batch-{j:06d}")
    return root


FILE_SECONDS = 500_000    # at most this old, well below the source's ``maxFileAge`` of a week


def _file_in_order(spark: SparkSession, path: str, root: str, n: int) -> bool:
    """Move the folders of micro-batches written at once under ``root`` and set
    their files' modification times to the order of the batches.  False, with
    nothing moved, where the file system keeps no times that are set."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    step = max(1, min(1000, 1000 * FILE_SECONDS // n))
    first = int(time.time()) * 1000 - n * step
    moves = []
    for j in range(n):
        folder = to(f"{path}/_batch={j}")
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            fs.setTimes(f.getPath(), first + j * step, -1)
            if fs.getFileStatus(f.getPath()).getModificationTime() != first + j * step:
                return False
        moves.append((folder, to(f"{root}/batch-{j:06d}")))
    fs.mkdirs(to(root))
    for folder, target in moves:
        if not (fs.rename(folder, target) if fs.exists(folder) else fs.mkdirs(target)):
            raise RuntimeError(f"could not write {target}")
    return True


def read_stream(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", FILES)
            .option("recursiveFileLookup", "true")
            .parquet(root))


def stream_partitions(spark: SparkSession) -> int:
    """Shuffle (and state) partitions of a stream: as many as tasks run at once.
    A micro-batch is small, and each costs a task a batch even when empty, with
    a state store and a Python worker; those of the session are for tables."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                      spark.sparkContext.defaultParallelism))


def _run(spark: SparkSession, writer, checkpoint: str, **settings: str):
    """Run a stream to its end; it begins with (and so keeps) the settings."""
    settings = {"spark.sql.shuffle.partitions": str(stream_partitions(spark)), **settings}
    before = {c: spark.conf.get(c, None) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        for c, v in before.items():
            if v is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, v)


# ---------------------------------------------------------------- ST1

# Buckets of a stream's factor and seen tables.  A micro-batch changes vectors of
# every bucket, so each is a file a version to write and to read again; up to 32
# folders are also listed without a job of their own.  More for larger tables.
STORE_BUCKETS = 16


class PrequentialBatch:
    """foreachBatch body: score every row before learning it, log, write
    version N+1.  A row is cold when neither version N nor an earlier row of
    the batch has its user, or its product."""

    def __init__(self, root: str, metrics_path: str, k: int, steps: int,
                 gamma_u: float, gamma_i: float, lam: float, blocks: int = config.GRID,
                 implicit: bool = False):
        self.root, self.metrics_path = root, metrics_path
        self.k, self.steps, self.gu, self.gi, self.lam = k, steps, gamma_u, gamma_i, lam
        self.blocks, self.implicit = blocks, implicit

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select("idx", "user", "product", "rating"))
        n, old = touched_factors(rows, self.root, batch_id)
        uf, pf = split_factors(old)
        facs, scores = score_and_learn(rows, old, self.k, self.steps, self.gu, self.gi, self.lam, ["idx"],
                                       blocks=self.blocks, implicit=self.implicit, n_rows=n)
        # what a task learns alone it scores alone, without shuffles
        rows = rows.coalesce(1) if n <= BUFFER_ROWS else rows
        firsts = (new_ids(rows, broadcast_if_fits(uf.select("id"), n, 24), "user")
                  .union(new_ids(rows, broadcast_if_fits(pf.select("id"), n, 24), "product")))
        firsts = (firsts.coalesce(1) if n <= BUFFER_ROWS else firsts).distinct().withColumn("is_cold", F.lit(True))
        pred = (rows.join(broadcast_if_fits(scores, n, 32), "idx")
                .join(broadcast_if_fits(firsts, n, 32), "idx", "left")
                .withColumn("is_cold", F.coalesce("is_cold", F.lit(False)))
                .withColumn("prediction", F.when(F.col("is_cold"), F.lit(config.COLD_START))
                            .otherwise(F.col("score"))))
        se = (F.col("rating") - F.col("prediction")) ** 2
        m = pred.agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"),
                     F.count(F.lit(1)).alias("n"),
                     F.sum(F.col("is_cold").cast("long")).alias("unknown"),
                     F.sqrt(F.avg(se)).alias("rmse")).withColumn("batch", F.lit(batch_id).cast("long"))
        uf, pf = split_factors(facs)
        together(spark,
                 lambda: (m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                          .partitionBy("batch").parquet(self.metrics_path)),
                 lambda: write_factors(uf, None, self.root, batch_id + 1),
                 lambda: write_factors(None, pf, self.root, batch_id + 1))


def together(spark: SparkSession, *outputs) -> None:
    """Write outputs of a micro-batch that do not depend on each other at the
    same time; raises what the first failing one raised, when all have ended."""
    with ThreadPoolExecutor(len(outputs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one)) for one in outputs]
    for one in running:
        one.result()


def touched_factors(rows: DataFrame, root: str, version: int) -> tuple[int, DataFrame]:
    """The number of ``rows``, and the vectors of their users and products as
    of a version in one table, read once."""
    stores = {side: stream_store(rows.sparkSession, root, side) for side in ("user", "product")}
    # a count and at most STORE_BUCKETS numbers a side
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.collect_set(store.bucket_of(side)).alias(side) for side, store in stores.items()]).first()
    uf, pf = (store.read(version, broadcast_if_fits(rows.select(F.col(side).cast("long").alias("id")), found["n"], 24),
                         found[side]) for side, store in stores.items())
    return found["n"], materialize(combine_factors(uf, pf, rows.sparkSession))


def stream_store(spark: SparkSession, root: str, side: str) -> VersionedTable:
    return factor_store(spark, root, side, buckets=STORE_BUCKETS)


def write_factors(uf: DataFrame | None, pf: DataFrame | None, root: str, version: int) -> None:
    """The vectors that a version changes (version 0: all there are); None
    writes nothing of that side."""
    for side, facs in (("user", uf), ("product", pf)):
        if facs is not None:
            stream_store(facs.sparkSession, root, side).write(version, facs)


def new_ids(rows: DataFrame, factors: DataFrame, col: str) -> DataFrame:
    """(idx): the first row of every id of ``col`` that has no vector yet."""
    return (rows.groupBy(F.col(col).cast("long").alias("id")).agg(F.min("idx").alias("idx"))
            .join(factors, "id", "left_anti").select("idx"))


def stream_prequential(stream: DataFrame, uf0: DataFrame, pf0: DataFrame, k: int, steps: int,
                       gamma_u: float, gamma_i: float, lam: float, blocks: int = config.GRID,
                       implicit: bool = False) -> DataFrame:
    """ST1: runs the stream to completion (availableNow) and returns the
    per-batch metrics (batch, lo, hi, n, unknown, rmse)."""
    spark = stream.sparkSession
    root = scratch_path(spark, "st1-factors")
    metrics = scratch_path(spark, "st1-metrics")
    write_factors(uf0, pf0, root, 0)
    body = PrequentialBatch(root, metrics, k, steps, gamma_u, gamma_i, lam, blocks, implicit)
    _run(spark, stream.writeStream.foreachBatch(body), scratch_path(spark, "st1-ckpt"))
    return spark.read.parquet(metrics).select("batch", "lo", "hi", "n", "unknown", "rmse")


# ---------------------------------------------------------------- ST2

BUFFER_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("user", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("b_idx", T.LongType()),
    T.StructField("b_product", T.LongType()),
    T.StructField("b_rating", T.DoubleType()),
])

PIECE_ROWS = 1 << 12        # events whose buffers are put out at once
STATE_BUCKETS = 512         # groups of users that share a state value
NULLS = ("user", "product", "rating")     # bits of ``nulls``, from 1

# of the rows in a bucket's buffers, users together and oldest first: packed columns
_KINDS = {"user": np.int64, "nulls": np.int64, "idx": np.int64, "product": np.int64, "rating": np.float64,
          "touched": np.int64}
_STATE_SCHEMA = T.StructType([T.StructField(c, T.BinaryType()) for c in _KINDS])
_EMITTED = T.StructType([T.StructField("nulls", T.LongType()), T.StructField("b_nulls", T.LongType()),
                         *BUFFER_SCHEMA.fields])


class LastKProcessor(StatefulProcessor):
    """Keeps each user's K newest (idx, product, rating) and emits the buffer
    (newest first) after every arriving rating.

    The key is a bucket of users, whose buffers are one packed state value: a
    key costs some milliseconds a micro-batch whatever its rows (calls to the
    state server, a frame in, a frame out), a user's rows next to nothing.
    Of a bucket's rows of a micro-batch a task holds a few numbers each (a
    stream has no order within a micro-batch, so they are sorted here); their
    buffers, K times as many rows, leave PIECE_ROWS events at a time.  With
    ``expire_ms`` a user's buffer is dropped that long after its last rating."""

    def __init__(self, last_k: int, expire_ms: int | None = None):
        self.last_k, self.expire_ms = last_k, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buf = handle.getValueState("buffer", _STATE_SCHEMA, ttlDurationMs=self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.last_k <= 0:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.expire_ms else 0
        packed = self.buf.get()
        old = {c: np.frombuffer(v, _KINDS[c]) for c, v in zip(_KINDS, packed)} if packed else {
            c: np.empty(0, t) for c, t in _KINDS.items()}
        if self.expire_ms:
            fresh = old["touched"] + self.expire_ms > now
            old = {c: v[fresh] for c, v in old.items()}
        parts = [old]
        for piece in rows:
            parts.append({c: piece[c].to_numpy(t) for c, t in _KINDS.items() if c != "touched"}
                         | {"touched": np.full(len(piece), now, np.int64)})
        at = {c: np.concatenate([p[c] for p in parts]) for c in _KINDS}
        n, n_old = len(at["idx"]), len(old["idx"])
        new = np.arange(n) >= n_old
        order = np.lexsort((np.where(new, at["idx"], np.arange(n)), new, at["user"], at["nulls"] & 1))
        at, new = {c: v[order] for c, v in at.items()}, new[order]
        starts = np.r_[True, (at["user"][1:] != at["user"][:-1]) | ((at["nulls"][1:] ^ at["nulls"][:-1]) & 1 > 0)]
        first = np.flatnonzero(starts)
        of = np.cumsum(starts) - 1
        arrived = np.flatnonzero(new)
        for lo in range(0, len(arrived), PIECE_ROWS):
            part = arrived[lo:lo + PIECE_ROWS]
            event = np.repeat(part, self.last_k)
            pos = np.tile(np.arange(self.last_k), len(part))
            event, pos = event[event - pos >= first[of[event]]], pos[event - pos >= first[of[event]]]
            b = event - pos
            yield pd.DataFrame({"nulls": at["nulls"][event], "b_nulls": at["nulls"][b], "idx": at["idx"][event],
                                "user": at["user"][event], "pos": pos, "b_idx": at["idx"][b],
                                "b_product": at["product"][b], "b_rating": at["rating"][b]})
        # a user's newest row says when it was last touched
        last = np.r_[first[1:], n]
        at["touched"] = at["touched"][last - 1][of]
        kept = last[of] - np.arange(n) <= self.last_k
        self.buf.update(tuple(at[c][kept].tobytes() for c in _KINDS))

    def close(self) -> None:
        pass


def stream_last_k(stream: DataFrame, last_k: int, expire_ms: int | None = None,
                  buckets: int = STATE_BUCKETS) -> DataFrame:
    """ST2: streaming last-K buffers; runs to completion and returns the
    emitted buffer rows (equal to the batch ``last_k_buffer`` while nothing
    expires).  A micro-batch reads and writes the buffers of the buckets of its
    users, so ``buckets`` should grow with the users; it must stay what it was
    when a stream was begun."""
    spark = stream.sparkSession
    out = scratch_path(spark, "st2-out")
    kinds = {"user": "long", "product": "long", "rating": "double"}
    nulls = sum((F.col(c).isNull().cast("long") * F.lit(1 << i) for i, c in enumerate(NULLS)), F.lit(0).cast("long"))
    keyed = stream.select(
        F.pmod(F.xxhash64(F.col("user").cast("long")), F.lit(buckets)).cast("int").alias("bucket"),
        F.col("idx").cast("long").alias("idx"), nulls.alias("nulls"),
        *[F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in kinds.items()])
    res = keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LastKProcessor(last_k, expire_ms), outputStructType=_EMITTED,
        outputMode="Append", timeMode="ProcessingTime" if expire_ms else "None")
    _run(spark, res.writeStream.format("parquet").option("path", out).outputMode("append"),
         scratch_path(spark, "st2-ckpt"), **{STATE_STORE: ROCKSDB})
    emitted = spark.read.schema(_EMITTED).parquet(out)
    for col, flags, side in (("user", "nulls", "user"), ("b_product", "b_nulls", "product"),
                             ("b_rating", "b_nulls", "rating")):
        known = F.col(flags).bitwiseAND(1 << NULLS.index(side)) == 0
        emitted = emitted.withColumn(col, F.when(known, F.col(col)))
    return emitted.select(*BUFFER_SCHEMA.names)


# ---------------------------------------------------------------- ST3

class RecommendBatch:
    """foreachBatch body: learn batch N on version N, write N+1, refresh
    the top R of the users the batch touched (seen set also versioned)."""

    def __init__(self, root: str, recs_path: str, k: int, steps: int, gamma_u: float,
                 gamma_i: float, lam: float, r: int, implicit: bool = True):
        self.root, self.recs_path = root, recs_path
        self.k, self.steps, self.gu, self.gi, self.lam, self.r = k, steps, gamma_u, gamma_i, lam, r
        self.implicit = implicit

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select("idx", F.col("user").cast("long").alias("user"),
                                        F.col("product").cast("long").alias("product"), "rating"))
        n, old = touched_factors(rows, self.root, batch_id)
        # afterwards, the vectors of the batch's users and products, none else
        uf, pf = online_update(rows, *split_factors(old), self.k, self.steps, self.gu, self.gi, self.lam,
                               ["idx"], implicit=self.implicit, n_rows=n)
        seen = seen_table(spark, self.root)
        together(spark,
                 lambda: write_factors(uf, None, self.root, batch_id + 1),
                 lambda: write_factors(None, pf, self.root, batch_id + 1),
                 lambda: seen.write(batch_id + 1, rows.select("user", "product").distinct()))
        # the batch's users against the whole catalogue
        catalogue = materialize(stream_store(spark, self.root, "product").read(batch_id + 1))
        recs = recommend_top_r(uf, catalogue, self.k, self.r, seen=seen.read(batch_id + 1, rows))
        (recs.select(F.lit(batch_id).cast("long").alias("batch"), "user", "product", "rank")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch").parquet(self.recs_path))


def seen_table(spark: SparkSession, root: str) -> VersionedTable:
    """(user, product) pairs that came by, as a versioned table by user."""
    return VersionedTable(spark, f"{root}/seen", "user long, product long", ["user", "product"],
                          buckets=STORE_BUCKETS)


def stream_recommend(stream: DataFrame, k: int, steps: int, gamma_u: float, gamma_i: float,
                     lam: float, r: int) -> DataFrame:
    """ST3: returns (batch, user, product, rank) refreshed per batch."""
    spark = stream.sparkSession
    root = scratch_path(spark, "st3-state")
    recs = scratch_path(spark, "st3-recs")
    write_factors(empty_factors(spark), empty_factors(spark), root, 0)
    seen_table(spark, root).write(0, spark.createDataFrame([], "user long, product long"))
    body = RecommendBatch(root, recs, k, steps, gamma_u, gamma_i, lam, r)
    _run(spark, stream.writeStream.foreachBatch(body), scratch_path(spark, "st3-ckpt"))
    return spark.read.parquet(recs).select("batch", "user", "product", "rank")
