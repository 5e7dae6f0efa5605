"""Prediction and ranking: L7 predict, J3 catalogue scoring, W7 top-k, L8.

Scoring every user against the whole catalogue is the one place where the
SQL form would be a cross join.  Here the catalogue is cut into buckets of
products of like norm, longest first, and users into blocks; a task gets one
block and one bucket (a cogroup of bounded size) and gives each user's best R
of the bucket.  |u.p| <= |u||p|, so a bucket whose longest vector cannot reach
a user's R-th best score needs no look: the first bucket sets that score, and
each user goes on only to the buckets that may beat or tie it.  The result is
exact.  Nothing of the catalogue but one number a bucket reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorcast import config
from factorcast.functions.vectors import cold_start_prediction, dot, is_cold, no_vector
from factorcast.operators.ordering import global_index
from factorcast.session import materialize
from factorcast.sources.factors import lookup_factors

SCORES = "user long, product long, score double"
BUCKET_CONF = "factorcast.bucketRows"        # products of a bucket
USER_BLOCK_CONF = "factorcast.userBlockRows"  # users of a block
DEFAULT_BUCKET = 1 << 12
DEFAULT_USER_BLOCK = 1 << 13
CELLS = 1 << 22              # (users x products) scored at once inside a task
SLACK = 1.0 + 1e-9           # bounds are compared with rounded scores


def predict(pairs: DataFrame, uf: DataFrame, pf: DataFrame, k: int,
            default: float = config.COLD_START, uf_rows: int | None = None,
            pf_rows: int | None = None) -> DataFrame:
    """L7 (J2 + X1 + X6): adds ``prediction`` and the explicit ``is_cold``."""
    j = lookup_factors(pairs, uf, pf, uf_rows=uf_rows, pf_rows=pf_rows, k=k)
    return (j.withColumn("prediction", cold_start_prediction("uf", "pf", k, default))
             .withColumn("is_cold", is_cold("uf", "pf"))
             .drop("uf", "pf"))


def top_k(scored: DataFrame, r: int, part: str = "user", score: str = "score",
          item: str = "product", out: str = "rank") -> DataFrame:
    """Best ``r`` per user by score desc, lower item id first on ties
    (planned as a WindowGroupLimit, i.e. partial top-r before the shuffle)."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(item).asc())
    return (scored.withColumn(out, F.row_number().over(w).cast("long"))
                  .where(F.col(out) <= r))


def _scores(u: np.ndarray, m: np.ndarray) -> np.ndarray:
    # left-to-right accumulation (same rounding as the unrolled SQL dot)
    s = u[:, 0:1] * m[None, :, 0]
    for j in range(1, m.shape[1]):
        s = s + u[:, j:j + 1] * m[None, :, j]
    return s


def _matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, k)


@dataclass
class Catalogue:
    """``products`` (bucket, id, f), buckets in order of falling norms, and
    ``longest``, the largest norm of each bucket (one number a bucket)."""
    products: DataFrame
    longest: np.ndarray

    @staticmethod
    def of(pf: DataFrame, k: int) -> Catalogue:
        rows = int(pf.sparkSession.conf.get(BUCKET_CONF, str(DEFAULT_BUCKET)))
        short = -F.sqrt(dot("f", "f", k))
        ranked = global_index(pf.select("id", "f", short.alias("short")), ["short", "id"], "at")
        products = ranked.select(F.floor(F.col("at") / rows).cast("int").alias("bucket"), "id", "f", "short")
        longest = products.groupBy("bucket").agg(F.max(-F.col("short")).alias("n")).collect()
        return Catalogue(products.drop("short"), np.array([r["n"] for r in sorted(longest)]))

    def within_reach(self, norm: Column, score: Column) -> Column:
        """Number of buckets (the first ones) that may hold a product whose
        score for a user of that norm is ``score`` or more; all if null."""
        shipped = self.products.sparkSession.sparkContext.broadcast(self.longest)

        @F.arrow_udf("int")
        def buckets(norms: pa.Array, scores: pa.Array) -> pa.Array:
            n = norms.to_numpy(zero_copy_only=False) * SLACK
            s = scores.to_numpy(zero_copy_only=False)
            least = np.divide(s, n, out=np.full(len(s), -np.inf), where=(n > 0) & (s > 0))
            least = np.where((n == 0) & (s > 0), np.inf, least)
            return pa.array(np.searchsorted(-shipped.value, -least, side="right").astype(np.int32))

        return buckets(norm, score)


def user_block(users: DataFrame, n_rows: int) -> Column:
    """Block of the column ``user``: about USER_BLOCK_CONF of ``n_rows`` rows."""
    size = int(users.sparkSession.conf.get(USER_BLOCK_CONF, str(DEFAULT_USER_BLOCK)))
    return F.pmod(F.xxhash64("user"), F.lit(max(1, -(-n_rows // size)))).cast("int").alias("block")


def meet(left: DataFrame, catalogue: Catalogue, fn, schema: str) -> DataFrame:
    """``fn(left rows, products)`` of every (block, bucket) that ``left`` has."""
    met = left.select("block", "bucket").distinct().join(catalogue.products, "bucket").select(
        *[F.col(c).alias(c) for c in ("block", "bucket", "id", "f")])    # columns of its own
    return left.groupBy("block", "bucket").cogroup(met.groupBy("block", "bucket")).applyInArrow(
        fn, schema)


def score_catalogue(users: DataFrame, pf: DataFrame, k: int, top: int | None = None,
                    seen: DataFrame | None = None) -> DataFrame:
    """J3 (+ FLT4 + W7 when ``top`` is given).

    users: (user, uf); pf: (id, f); seen: optional (user, product) pairs to
    exclude.  Returns (user, product, score) for every user x product, or
    only each user's best ``top`` unseen products (lower id on ties).

    The seen pairs travel to the (block, bucket) of their user and product,
    so a task gets those it needs and no set per user is ever built.  With
    ``top`` at most that many rows leave a task per user."""
    catalogue = Catalogue.of(pf, k)
    n_buckets = len(catalogue.longest)
    u = users.select(F.col("user").cast("long").alias("user"), "uf")
    u = materialize(u.select("user", "uf", user_block(u, u.count())))
    pairs = None
    if seen is not None:
        pairs = (seen.select(F.col("user").cast("long").alias("user"),
                             F.col("product").cast("long").alias("product")).distinct()
                 .join(u.select("user", "block"), "user")
                 .join(catalogue.products.select(F.col("id").alias("product"), "bucket"), "product"))
    score = _score_fn(k, top)

    def search(wanted: DataFrame, first: int) -> DataFrame:
        """Of the buckets ``first`` .. ``last`` (exclusive) of each user."""
        rows = wanted.where(F.col("last") > first).select(
            "block", F.explode(F.sequence(F.lit(first), F.col("last") - 1)).alias("bucket"),
            "user", "uf", F.lit(None).cast("long").alias("product"))
        if pairs is not None:
            rows = rows.unionByName(pairs.withColumn("uf", no_vector()).join(
                rows.select("block", "bucket").distinct(), ["block", "bucket"], "left_semi"))
        return meet(rows, catalogue, score, SCORES)

    if top is None or n_buckets <= 1:
        return search(u.withColumn("last", F.lit(n_buckets)), 0)
    best = materialize(search(u.withColumn("last", F.lit(1)), 0))
    least = best.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reach = catalogue.within_reach(F.sqrt(dot("uf", "uf", k)), F.when(F.col("n") == top, F.col("least")))
    more = search(u.join(least, "user", "left").withColumn("last", reach), 1)
    return top_k(best.unionByName(more), top).drop("rank")


def _score_fn(k: int, top: int | None):
    def fn(key: tuple, left: pa.Table, products: pa.Table) -> pa.Table:
        order = np.argsort(products["id"].to_numpy())
        ids, vectors = products["id"].to_numpy()[order], _matrix(products["f"], k)[order]
        is_user = left["product"].is_null()
        rows, seen = left.filter(is_user), left.filter(left["product"].is_valid())
        users, uf = rows["user"].to_numpy(), _matrix(rows["uf"], k)
        by_user = np.argsort(users)
        # a seen pair's user may be one that does not search this bucket
        at = by_user[np.minimum(np.searchsorted(users, seen["user"].to_numpy(), sorter=by_user),
                                max(len(users) - 1, 0))] if len(users) else np.zeros(0, np.int64)
        mine = users[at] == seen["user"].to_numpy() if len(users) else np.zeros(0, bool)
        at, product = at[mine], np.searchsorted(ids, seen["product"].to_numpy())[mine] if len(users) else at
        out: list[tuple] = []
        step = max(1, CELLS // max(len(ids), 1))
        for lo in range(0, len(users), step):
            s = _scores(uf[lo:lo + step], vectors)
            here = (at >= lo) & (at < lo + step)
            keep = np.ones(s.shape, bool)
            keep[at[here] - lo, product[here]] = False
            if top is not None and top < len(ids):
                masked = np.where(keep, s, -np.inf)
                bar = -np.partition(-masked, top - 1, axis=1)[:, top - 1]
                keep &= masked >= bar[:, None]
            i, j = np.nonzero(keep)
            if top is not None:
                # ids ascend within a user: a stable sort leaves ties in id order
                by = np.lexsort((-s[i, j], i))
                i, j = i[by], j[by]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[nth < top], j[nth < top]
            out.append((users[lo + i], ids[j], s[i, j]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({"user": pa.array(columns[0], pa.int64()), "product": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return fn


def recommend_top_r(uf: DataFrame, pf: DataFrame, k: int, r: int,
                    seen: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Each user's best ``r`` products not in ``seen``, with 1-based rank.

    ``users`` restricts the users scored (e.g. users touched in a batch)."""
    u = uf.select(F.col("id").alias("user"), F.col("f").alias("uf"))
    if users is not None:
        u = u.join(users.select(F.col("user").cast("long").alias("user")).distinct(),
                   "user", "left_semi")
    best = score_catalogue(u, pf, k, top=r, seen=seen)
    w = Window.partitionBy("user").orderBy(F.col("score").desc(), F.col("product").asc())
    return best.withColumn("rank", F.row_number().over(w).cast("long"))
