"""Operator 6: embedding near-duplicates by iterative quantisation.

Rotations for balanced binary codes are learned on a bounded sample (PCA
without centring, as cosine is compared, then alternating sign and
Procrustes steps, from different starts).  Every vector is coded and indexed;
multi-index Hamming tables retrieve pairs whose codes lie within ``radius``
bits in one table's segment, and each is reranked by the cosine of the
original vectors in double precision: none below the threshold is linked.
Equal vectors are one class first, so copies are never paired.

Scale: a segment is SPARE_BITS wider than log2 of the number of different
vectors (:func:`plan_tables`), so where codes are spread evenly a vector meets a
bounded number of chance candidates in each table (groups of near vectors
meet more), and there are as many tables as the stated recall
takes for a pair exactly at the threshold; their number grows as a small
power of the vectors.  Pairs that do lie within the threshold are all made,
as ``n_links`` counts them.

Defined results: vectors that are null, zero or hold a null or non-finite
component link with nothing; vectors of different lengths never link; codes
use the first components of vectors longer than those of the sample; rows
that repeat id or vector are vectors of their own, a null id counts as a
link but never names a component that has another; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import components, lookup, materialize, pieces, uniform
from factorcast.llm.simhash import ball

FIT_ROWS = 20_000      # bound of the sample that the rotation is learned on
ROUNDS = 40
LEAST_WIDTH, SPARE_BITS, MOST_WIDTH = 16, 4, 46    # of a segment, in bits
TABLE_BIT = 48         # a cell is its table's number above this bit and the segment below
ROTATION_BITS = 256    # most bits of one rotation


def fit_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Projection (dimensions x bits) of iterative quantisation."""
    values, axes = np.linalg.eigh(x.T @ x)
    project = axes[:, np.argsort(values)[::-1][:bits]]
    v = x @ project
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ wt).T
    return project @ turn


def _unit(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :min(width, len(r))] = r[:width]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def plan_tables(n: int, threshold: float, recall: float, radius: int) -> tuple[int, int]:
    """(tables, bits of a segment) for ``n`` vectors.

    A bit differs with probability angle / pi, so a segment of a pair at the
    threshold lies within the radius with a binomial probability; the tables
    are as many as miss it with at most 1 - ``recall``."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    differs = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meets = sum(math.comb(width, k) * differs ** k * (1 - differs) ** (width - k)
                for k in range(radius + 1))
    return (1 if meets >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meets))), width


def fit_tables(x: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Projection (dimensions x tables * width) of as many rotations as that takes."""
    need = tables * width
    bits = min(need, ROTATION_BITS, x.shape[1])
    turns = [fit_rotation(x, bits, seed=7 + i) for i in range(-(-need // bits))]
    return np.concatenate(turns, axis=1)[:, :need]


def coder(projection: np.ndarray, width: int):
    """Arrow function vector -> its cell in each table (array of long)."""
    tables = projection.shape[1] // width
    powers = 1 << np.arange(width, dtype=np.int64)
    names = np.arange(tables, dtype=np.int64) << TABLE_BIT

    @F.arrow_udf("array<long>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            on = _unit(batch.to_pylist(), projection.shape[0]) @ projection > 0
            cells = on.reshape(-1, tables, width) @ powers + names
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables),
                pa.array(cells.ravel()))

    return code


def retrieve(coded: DataFrame, width: int, radius: int) -> DataFrame:
    """(a, b), a before b: the pairs of rows of ``coded`` (_class, _cells) that
    lie within ``radius`` bits in some table; each pair once."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
    index = coded.select(F.col("_class").alias("b"), F.explode("_cells").alias("_cell"))
    probes = coded.select(F.col("_class").alias("a"), F.explode(F.flatten(F.transform(
        "_cells", lambda c: F.transform(masks, lambda m: c.bitwiseXOR(m))))).alias("_cell"))
    return probes.join(index, "_cell").where("a < b").select("a", "b").distinct()


def usable(v: Column) -> Column:
    """True for a vector of finite components that is not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 threshold: float = 0.9, recall: float = 0.95, radius: int = 1,
                 fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept): a row per vector.  ``recall``: the
    share of pairs exactly at the threshold that the tables are planned for."""
    rows = vectors.select(F.col(id_col).alias("_id"),
                          F.col(vec_col).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_ok", usable(F.col("_v"))).withColumn(
        "_key", F.when(F.col("_ok"), F.concat(F.hex(F.xxhash64(F.lit(1), "_v")),
                                              F.lit("-"), F.hex(F.xxhash64(F.lit(2), "_v")))))
    classes = materialize(rows.where("_ok").groupBy("_key").agg(
        F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.first("_v").alias("_v")
    ).withColumn("_class", F.monotonically_increasing_id()))    # fixed by the checkpoint
    alone = rows.where("not _ok").select(
        F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
        F.col("_id").alias("component_id"))
    n = classes.count()
    if n == 0:
        return alone.withColumn("kept", F.lit(True))
    sample = classes.where(uniform(F.col("_key"), "itq") < min(1.0, fit_rows / n)).select("_v")
    fit = [r[0] for r in sample.collect()] or [classes.first()["_v"]]
    width = max(len(v) for v in fit)
    tables, bits = plan_tables(n, threshold, recall, radius)
    projection = fit_tables(_unit(fit, width), tables, bits)
    coded = materialize(classes.select("_class", coder(projection, bits)("_v").alias("_cells")))
    left = classes.select(F.col("_class").alias("a"), F.col("_v").alias("_va"))
    right = classes.select(F.col("_class").alias("b"), F.col("_v").alias("_vb"))
    links = materialize(retrieve(coded, bits, radius).join(left, "a").join(right, "b").where(
        (F.size("_va") == F.size("_vb")) & (cosine(F.col("_va"), F.col("_vb")) >= threshold)
    ).select("a", "b"))
    both = links.union(links.select("b", "a"))
    counts = both.join(classes.select(F.col("_class").alias("b"), "_n"), "b").groupBy("a").agg(
        F.sum("_n").alias("_others"))
    found = materialize(components(links))
    roots = found.join(classes.select("_class", "_least"), found["node"] == F.col("_class")
                       ).groupBy("component").agg(F.min("_least").alias("_root"))
    linked = found.join(roots, "component").select(F.col("node").alias("_class"), "_root")
    keyed = classes.drop("_v").join(linked, "_class", "left").join(
        counts.withColumnRenamed("a", "_class"), "_class", "left").select(
        "_key", "_n", (F.col("_n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"),
        F.coalesce("_root", "_least").alias("component_id"))
    total = classes.agg(F.sum("_n")).first()[0]
    members = lookup(rows.where("_ok").select("_id", "_key"), materialize(keyed), "_key", "_id",
                     "_n", total)
    return members.select(F.col("_id").alias(id_col), "n_links", "component_id").union(
        alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
