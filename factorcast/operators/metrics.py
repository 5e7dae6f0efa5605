"""Error and recall aggregates (partial + final aggregation, no driver loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorcast.functions.vectors import squared_error


def rmse(df: DataFrame, rating: str = "rating", prediction: str = "prediction",
         group_cols: list[str] | None = None) -> DataFrame:
    """A1/A2/A4: n, sum of squared error, RMSE and cold-start count."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(squared_error(rating, prediction)).alias("sse"),
        F.sqrt(F.avg(squared_error(rating, prediction))).alias("rmse"),
    ]
    if "is_cold" in df.columns:
        aggs.append(F.sum(F.col("is_cold").cast("long")).alias("unknown"))
    g = df.groupBy(*group_cols) if group_cols else df
    return g.agg(*aggs)


def round_metric(df: DataFrame, idx: str, size: int, value_expr, name: str,
                 group_cols: list[str] | None = None) -> DataFrame:
    """Metric per consecutive ``size`` rows of ``idx`` (0-based within
    the evaluated stream); the last, partial round is not emitted."""
    gc = group_cols or []
    r = F.floor(F.col(idx) / F.lit(size)).cast("long")
    out = (df.withColumn("round", r + 1)
           .groupBy(*gc, "round")
           .agg(F.count(F.lit(1)).alias("n"), value_expr.alias(name)))
    return out.where(F.col("n") == size)


def round_rmse(df: DataFrame, idx: str, size: int, rating: str = "rating",
               prediction: str = "prediction") -> DataFrame:
    """A3: RMSE per ``size`` test rows."""
    return round_metric(df, idx, size,
                        F.sqrt(F.avg(squared_error(rating, prediction))), "rmse")


def unknown_count(df: DataFrame) -> DataFrame:
    """A4: number of cold-start predictions (flag, never float equality)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col("is_cold").cast("long")).alias("unknown"))


def mean_recall(df: DataFrame, recall: str = "recall") -> DataFrame:
    """A5: mean recall over kept (non-null) samples."""
    kept = df.where(F.col(recall).isNotNull())
    return kept.agg(F.count(F.lit(1)).alias("n"), F.avg(recall).alias("recall"))


def sum_count(df: DataFrame, value: str) -> DataFrame:
    """A2: (count, sum) with partial aggregation (tree-reduce equivalent)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def gradient_aggregate(df: DataFrame, id_col: str, grad_exprs: list, prefix: str = "g") -> DataFrame:
    """Mean gradient per entity (map-side partial aggregation makes a
    hot id cheap: each task ships one partial row per id).  A row's gradient
    elements are all null or none, so one count serves them all."""
    known = F.nullif(F.count(grad_exprs[0]), F.lit(0)) if grad_exprs else None
    return df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.sum(g) / known).alias(f"{prefix}{j}") for j, g in enumerate(grad_exprs)])
