"""Sinks: metrics table (SNK2), recommendation log (SNK3), scratch paths."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorcast.session import ensure_checkpoint_dir

METRICS_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("round", T.LongType()),
    T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("unknown", T.LongType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("train_ms", T.LongType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/factorcast-io/{name}-{uuid.uuid4().hex}"


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that ``scratch_path`` gave, and nothing else."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    inside = to(f"{ensure_checkpoint_dir(spark).rstrip('/')}/factorcast-io").toUri().getPath() + "/"
    target = to(path)
    if target.toUri().getPath().startswith(inside):
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def metrics_rows(df: DataFrame, run: str, protocol: str, train_ms: int | None = None) -> DataFrame:
    """Conform any metrics frame to the metrics table schema (columns it lacks
    are null; an overall row has a null round)."""
    given = {"run": F.lit(run), "protocol": F.lit(protocol), "train_ms": F.lit(train_ms)}
    return df.select(*[
        given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in METRICS_SCHEMA.fields])


def write_metrics(df: DataFrame, path: str, run: str, protocol: str,
                  train_ms: int | None = None) -> None:
    """SNK2: the metrics of one protocol of one run, a partition of its own
    that a rerun replaces; other runs and protocols stay."""
    (metrics_rows(df, run, protocol, train_ms).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run", "protocol").parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(path).select(*METRICS_SCHEMA.names)


class Timed:
    """Milliseconds of a block of code, e.g. a training's cost."""

    def __enter__(self) -> Timed:
        self.start = time.monotonic()
        return self

    def __exit__(self, *error) -> None:
        self.ms = int((time.monotonic() - self.start) * 1000)


def recommendation_log(recs: DataFrame, future: DataFrame, key: str = "idx") -> DataFrame:
    """SNK3: per event, recommended ids in rank order and future ids
    (ascending), as arrays.  recs: (key, product, rank); future: (key, product)."""
    r = recs.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "product"))).alias("_r"))
    r = r.select(key, F.col("_r.product").alias("recommended"))
    f = future.groupBy(key).agg(F.sort_array(F.collect_set("product")).alias("future"))
    return r.join(f, key, "full_outer")
