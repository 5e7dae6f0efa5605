"""Session helpers: defaults, reliable checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound (bytes) for a side we hint as broadcast; beyond it the join
# falls back to a shuffle join (with AQE skew handling).
BROADCAST_MAX_BYTES_CONF = "factorcast.broadcastMaxBytes"
DEFAULT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "factorcast") -> SparkSession:
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # iterative jobs checkpoint every epoch / stratum / micro-batch: let
        # Spark delete checkpoint files once their frames are unreachable
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session
    without one gets a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factorcast-ckpt-"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster")
    return sc.getCheckpointDir()


@contextmanager
def without_adaptive(spark: SparkSession):
    """Within, plans are made whole before they run."""
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def materialize(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss).

    ``keep_partitioning``: the checkpoint is planned without AQE, because an
    adaptive plan reports UnknownPartitioning at checkpoint time; the
    checkpointed frame then carries its hash partitioning, and later joins
    or aggregations on the same keys (same partition count) need no
    exchange of this side."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    with without_adaptive(spark):
        return df.checkpoint(eager=True)


def broadcast_max_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_MAX_BYTES_CONF,
                              str(DEFAULT_BROADCAST_MAX_BYTES)))


def broadcast_if_fits(df: DataFrame, n_rows: int, row_bytes: int, otherwise: str | None = None) -> DataFrame:
    """Hint a broadcast only when the exact row count times the row width
    is under the limit; else the hint ``otherwise``, or leave the join to the
    planner/AQE."""
    if n_rows * row_bytes <= broadcast_max_bytes(df.sparkSession):
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def factor_row_bytes(k: int) -> int:
    # id (8) + array header (16) + k doubles + row overhead (16)
    return 40 + 8 * k
