"""Learning operators.

L1  ``batch_gd``       deterministic full-batch gradient descent (pure SQL plan).
L2  ``block_sgd``      true SGD inside conflict-free (user block, product block)
                        strata (stratified DSGD); one task per block.
L3  ``distributed_sgd`` = L2 with one learning rate for both sides.
L4  ``online_update``  T consecutive SGD steps per arriving rating, on a batch.
L5  ``last_k_replay``  replay each user's last K ratings twice per event.
L6  ``user_fold_in``   exact per-user sequence, product vectors frozen.

The update everywhere reads both old vectors:
    e = r - uf.pf;  uf' = uf + g_u (e pf - lambda uf);  pf' = pf + g_i (e uf - lambda pf)
Factors are stored as (id, f ARRAY<DOUBLE>) and every epoch / stratum is
materialized with a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorcast import config
from factorcast.functions.vectors import dot, init_product_factor, init_user_factor, no_vector
from factorcast.operators.ordering import global_index, row_hash, shuffle_key
from factorcast.session import (broadcast_if_fits, broadcast_max_bytes, factor_row_bytes, materialize,
                                without_adaptive)
from factorcast.sources.factors import init_factors
from factorcast.sources.sinks import delete_scratch, scratch_path

FACTOR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("f", T.ArrayType(T.DoubleType())),
])


# ---------------------------------------------------------------- L1

HOT_ROWS_CONF = "factorcast.hotKeyRows"
DEFAULT_HOT_ROWS = 1 << 20


def _batch_step(train: DataFrame, uf: DataFrame, pf: DataFrame, salts: DataFrame, k: int,
                gamma: float, lam: float, pf_rows: int, n_parts: int, keys: list[str]):
    # user vectors go to the ratings' partitions: one copy per salt of a hot
    # user, one copy otherwise; only factor rows are exchanged here
    u = (uf.select(*keys, F.col("id").alias("user"), F.col("f").alias("uf"))
         .join(salts, keys + ["user"], "left")
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("ns"), F.lit(1)) - 1)))
         .drop("ns").repartition(n_parts, *keys, "user", "salt"))
    p = broadcast_if_fits(pf.select(*keys, F.col("id").alias("product"), F.col("f").alias("pf")),
                          pf_rows, factor_row_bytes(k))
    j = (train.join(u, keys + ["user", "salt"]).join(p, keys + ["product"])
         .select(*keys, "user", "product", "uf", "pf",
                 (F.col("rating") - dot("uf", "pf", k)).alias("e")))
    # one pass over the ratings emits both sides' gradient rows; a single
    # partial+final aggregation then averages them per (side, id)
    e = F.col("e")
    both = F.explode(F.array(
        F.struct(F.lit("u").alias("side"), F.col("user").alias("id"),
                 F.array(*[e * F.col("pf")[i] for i in range(k)]).alias("g")),
        F.struct(F.lit("p").alias("side"), F.col("product").alias("id"),
                 F.array(*[e * F.col("uf")[i] for i in range(k)]).alias("g"))))
    rows = j.select(*keys, both.alias("r")).select(*keys, "r.side", "r.id", "r.g")
    # all k elements are null or none, so one count serves them: an average
    # each would ship k more counts a partial row
    n = F.nullif(F.count(F.col("g")[0]), F.lit(0))
    grads = materialize(rows.groupBy(*keys, "side", "id").agg(
        *[(F.sum(F.col("g")[i]) / n).alias(f"g{i}") for i in range(k)]))

    def apply(old: DataFrame, side: str) -> DataFrame:
        g = grads.where(F.col("side") == side).drop("side")
        m = old.join(g, keys + ["id"], "left")
        f = F.col("f")
        new = F.array(*[F.when(F.col(f"g{i}").isNull(), f[i])
                        .otherwise(f[i] + F.lit(gamma) * (F.col(f"g{i}") - F.lit(lam) * f[i]))
                        for i in range(k)])
        return m.select(*keys, "id", new.alias("f"))

    return materialize(apply(uf, "u")), materialize(apply(pf, "p"))


def batch_gd(train: DataFrame, k: int, epochs: int, gamma: float, lam: float,
             uf: DataFrame | None = None, pf: DataFrame | None = None,
             implicit: bool = False, num_partitions: int | None = None,
             keys: list[str] | None = None):
    """L1: ``epochs`` full-batch steps with the mean gradient per id.

    ``keys`` trains independent models side by side (e.g. one per
    evaluation round): factor tables are then keyed by (*keys, id).

    Plan per epoch: the ratings are hash-partitioned once by (user, salt)
    and checkpointed with that partitioning and order, so they never move
    again; the user table is exploded per salt and shuffled to them (only
    factor rows move).  A user with more than ``factorcast.hotKeyRows``
    ratings is salted over ceil(count / hotKeyRows) partitions, so a user
    holding a third of all rows does not land in one task.  The product
    table is broadcast when its exact size fits, else shuffle-joined (AQE
    splits a skewed product partition).  Both gradients come from one pass
    and one partial+final aggregation.  Returns (uf, pf) factor tables."""
    spark = train.sparkSession
    keys = list(keys or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    base = train.select(*keys, F.col("user").cast("long").alias("user"),
                        F.col("product").cast("long").alias("product"),
                        F.col("rating").cast("double").alias("rating"))
    # hot users: at most (rows / hotKeyRows) of them, so the table is bounded
    salts = materialize(base.groupBy(*keys, "user").agg(F.count(F.lit(1)).alias("c"))
                        .where(F.col("c") > hot)
                        .select(*keys, "user", F.ceil(F.col("c") / F.lit(hot)).cast("int").alias("ns")))
    salts = broadcast_if_fits(salts, salts.count(), 48)
    salt = F.coalesce(F.pmod(F.xxhash64("product", "rating"), F.col("ns")), F.lit(0))
    tr = base.join(salts, keys + ["user"], "left").withColumn("salt", salt.cast("int")).drop("ns")
    tr = materialize(tr.repartition(n, *keys, "user", "salt").sortWithinPartitions(*keys, "user", "salt"),
                     keep_partitioning=True)
    if uf is None:
        uf = _init_keyed(tr, "user", k, "user", implicit, keys)
    if pf is None:
        pf = _init_keyed(tr, "product", k, "product", implicit, keys)
    uf = materialize(uf)
    pf = materialize(pf)
    pf_rows = pf.count()
    for _ in range(epochs):
        uf, pf = _batch_step(tr, uf, pf, salts, k, gamma, lam, pf_rows, n, keys)
    return uf, pf


def _init_keyed(tr: DataFrame, col: str, k: int, side: str, implicit: bool, keys: list[str]):
    if not keys:
        return init_factors(tr, col, k, side, implicit)
    make = init_user_factor if side == "user" else init_product_factor
    d = tr.select(*keys, F.col(col).alias("id")).distinct()
    return d.select(*keys, "id", make("id", k, implicit).alias("f"))


# ---------------------------------------------------------------- numpy kernel

class Vectors:
    """Vectors of one side by id, in a matrix that grows; an id without one
    starts from the deterministic rule."""

    def __init__(self, k: int, salt: int, scale: float):
        self.k, self.salt, self.scale = k, salt, scale
        self.at: dict[int, int] = {}
        self.f = np.empty((1024, k))

    def put(self, ids: list[int], vectors: np.ndarray) -> None:
        """Vectors of new ids."""
        first = len(self.at)
        while first + len(ids) > len(self.f):
            self.f = np.concatenate([self.f, np.empty_like(self.f)])
        self.at.update(zip(ids, range(first, first + len(ids))))
        self.f[first:first + len(ids)] = vectors

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Matrix row of each id."""
        distinct, inverse = np.unique(ids, return_inverse=True)
        missing = [i for i in distinct.tolist() if i not in self.at]
        if missing:
            self.put(missing, init_matrix(np.array(missing, np.int64), self.k, self.salt, self.scale))
        return np.array([self.at[i] for i in distinct.tolist()], np.int64)[inverse]


def wave_levels(users: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Wave of each row of a sequence, from 0 (see ``sgd_sequence``)."""
    last_u: dict[int, int] = {}
    last_p: dict[int, int] = {}
    level = [0] * len(users)
    for j, (a, b) in enumerate(zip(users.tolist(), products.tolist())):
        x, y = last_u.get(a, 0), last_p.get(b, 0)
        level[j] = x if x > y else y
        last_u[a] = last_p[b] = level[j] + 1
    return np.asarray(level, np.int64)


def sgd_sequence(users: np.ndarray, products: np.ndarray, ratings: np.ndarray,
                 U: Vectors, P: Vectors, steps: int, gu: float, gi: float, lam: float,
                 trail: tuple[np.ndarray, np.ndarray] | None = None,
                 level: np.ndarray | None = None) -> np.ndarray:
    """Sequential SGD over rows in the given order, ``steps`` consecutive
    updates per row.  Changes the vectors and returns each row's score
    before its own update (the dot product of its vectors as all earlier
    rows left them).  ``trail``, two matrices, gets each row's user vector
    before and product vector after its update.

    Exact wavefront form: a row depends on earlier rows only through its
    user and its product, so row j goes to wave 1 + max(wave of the last
    earlier row with the same user, same product).  Rows of one wave touch
    distinct users and distinct products and are updated together with
    numpy, producing bit-for-bit the sequential result (same operations,
    same order per element).  ``level``: the rows' waves, where known."""
    n = len(users)
    scores = np.empty(n)
    if n == 0:
        return scores
    ua, pa = U.rows(users), P.rows(products)
    if level is None:
        level = wave_levels(ua, pa)
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(level.max() + 2))
    for w in range(len(bounds) - 1):
        rows = order[bounds[w]:bounds[w + 1]]
        uf, pf, rr = U.f[ua[rows]], P.f[pa[rows]], ratings[rows]
        if trail:
            trail[0][rows] = uf
        for step in range(steps):
            s = uf[:, 0] * pf[:, 0]
            for c in range(1, U.k):
                s = s + uf[:, c] * pf[:, c]
            if step == 0:
                scores[rows] = s
            e = (rr - s)[:, None]
            uf, pf = uf + gu * (e * pf - lam * uf), pf + gi * (e * uf - lam * pf)
        U.f[ua[rows]] = uf
        P.f[pa[rows]] = pf
        if trail:
            trail[1][rows] = pf
    return scores


def init_matrix(ids: np.ndarray, k: int, salt: int, scale: float) -> np.ndarray:
    j = np.arange(k, dtype=np.int64)[None, :]
    x = (ids.astype(np.int64)[:, None] * config.INIT_ID_MULT + (j * config.INIT_J_MULT + salt)) % config.INIT_MOD
    return np.sqrt(x / float(config.INIT_MOD) * scale / float(k))


# ---------------------------------------------------------------- L2 / L3 / L4

# rows of a block learned at once; what a task holds besides its vectors
BUFFER_ROWS = 1 << 16


def block_of(col: str, d: int):
    """Virtual block of an id: an arithmetic hash that SQL engines agree on."""
    return F.pmod(row_hash([col]), F.lit(d)).cast("int")


def empty_factors(spark, keys: list[str] | None = None, key_types: dict | None = None) -> DataFrame:
    fields = [T.StructField(c, (key_types or {}).get(c, T.LongType())) for c in (keys or [])]
    return spark.createDataFrame([], T.StructType(fields + list(FACTOR_SCHEMA.fields)))


def _block_stream(k: int, gu: float, gi: float, lam: float, steps: int, scale: float, keys: list[str],
                  trail: bool = False):
    """Learns the blocks of a partition from one sorted stream.

    Rows come by (keys, block); of each block first its vectors (side 'u' or
    'p', id, f), then its ratings (side null, id = the score's id or null) in
    visiting order.  A task holds the vectors of one block and BUFFER_ROWS
    ratings, however many ratings the block has.  Scores (side 'r') leave as
    they come, and with ``trail`` the user vector before ('b') and the product
    vector after ('a') each rating; vectors leave at the end of their block.
    Scores of earlier strata pass through."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in keys] + [
        T.StructField("side", T.StringType())] + list(FACTOR_SCHEMA.fields))
    names = [f.name for f in schema.fields]
    group = keys + ["g"]

    def out(key: tuple, side: str, ids, vectors: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), v, np.int64)) for v in key[:len(keys)]]
            + [pa.array([side] * len(ids)), pa.array(ids, pa.int64()),
               pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held = None, [], 0
        U = P = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if held:
                rows = pa.Table.from_batches(held)
                path = (np.empty((n_held, k)), np.empty((n_held, k))) if trail else None
                scores = sgd_sequence(*(rows[c].to_numpy() for c in ("user", "product", "rating")),
                                      U, P, steps, gu, gi, lam, path)
                wanted = rows["id"].is_valid().to_numpy()
                if wanted.any():
                    ids = rows["id"].drop_null().to_numpy()
                    yield out(key, "r", ids, scores[wanted][:, None])
                    for side, vectors in zip("ba", path or ()):
                        yield out(key, side, ids, vectors[wanted])
                held, n_held = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            yield from flush()
            for side, V in (("u", U), ("p", P)):
                ids = np.fromiter(V.at, np.int64, len(V.at))
                for a in range(0, len(ids), BUFFER_ROWS):
                    yield out(key, side, ids[a:a + BUFFER_ROWS], V.f[a:min(a + BUFFER_ROWS, len(ids))])

        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in group])
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                now = tuple(int(v) for v in of[:, lo])
                if now != key:
                    if key is not None:
                        yield from close()
                    key = now
                    U, P = Vectors(k, config.USER_SALT, scale), Vectors(k, config.PRODUCT_SALT, scale)
                part = batch.slice(lo, hi - lo)
                side = part.column("side")
                done = part.filter(pc.fill_null(pc.is_in(side, pa.array(["r", "b", "a"])), False))
                if done.num_rows:
                    yield done.select(names)
                for name, V in (("u", U), ("p", P)):
                    mine = part.filter(pc.fill_null(pc.equal(side, name), False))
                    if mine.num_rows:
                        f = mine.column("f").flatten().to_numpy().reshape(mine.num_rows, k)
                        V.put(mine.column("id").to_pylist(), f)
                rows = part.filter(side.is_null()).select(["id", "user", "product", "rating"])
                if rows.num_rows:
                    held.append(rows)
                    n_held += rows.num_rows
                    if n_held >= BUFFER_ROWS:
                        yield from flush()
        if key is not None:
            yield from close()

    return learn, schema


def combine_factors(uf: DataFrame | None, pf: DataFrame | None, spark,
                    keys: list[str] | None = None) -> DataFrame:
    """(uf, pf) -> one factor table (keys, side, id, f), side 'u' / 'p'."""
    keys = list(keys or [])
    u = (uf if uf is not None else empty_factors(spark, keys)).select(*keys, F.lit("u").alias("side"), "id", "f")
    p = (pf if pf is not None else empty_factors(spark, keys)).select(*keys, F.lit("p").alias("side"), "id", "f")
    return u.unionByName(p)


def split_factors(facs: DataFrame, keys: list[str] | None = None):
    keys = list(keys or [])
    return (facs.where(F.col("side") == "u").select(*keys, "id", "f"),
            facs.where(F.col("side") == "p").select(*keys, "id", "f"))


def block_sgd_table(train: DataFrame, facs: DataFrame, k: int, epochs: int, gamma_u: float,
                    gamma_i: float, lam: float, blocks: int = config.GRID,
                    order_cols: list[str] | None = None, steps_per_row: int = 1,
                    shuffle: bool = True, seed: int = config.SEED, implicit: bool = False,
                    keys: list[str] | None = None, score_id: str | None = None,
                    trail: bool = False, restage: bool = True, n_rows: int | None = None):
    """L2 on a combined factor table; returns the new combined table
    (see ``block_sgd``).  ``restage``: write the rows by stratum first; without,
    each stratum scans all of them, which suits a micro-batch.  ``n_rows``, for
    a ``facs`` of vectors of the rows' ids alone: how many rows there are; few
    are learned by one task, stratum after stratum, which visits them in the
    same order.  With ``score_id`` (a nullable long column) returns
    (table, scores): scores holds (keys, score_id, score), the score before
    the row's own update, of every visit whose ``score_id`` is not null; with
    ``trail`` also (before, after), the user's vector before and the
    product's after the update."""
    spark = train.sparkSession
    keys = list(keys or [])
    d = max(1, int(blocks))
    scale = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    order_names = list(order_cols or [])
    base = (*keys, "user", "product", "rating")
    tr = train.select(*keys, F.col("user").cast("long").alias("user"),
                      F.col("product").cast("long").alias("product"),
                      F.col("rating").cast("double").alias("rating"),
                      *[c for c in dict.fromkeys(order_names + [score_id or "user"]) if c not in base])
    stratum = F.pmod(block_of("product", d) - block_of("user", d), F.lit(d))
    tr = tr.withColumn("g", block_of("user", d)).withColumn("stratum", stratum)
    # rows without a user or product are in no stratum
    alone, path = n_rows is not None and n_rows <= BUFFER_ROWS and not keys, None
    if alone:
        tr = tr.where("stratum IS NOT NULL")
    elif restage and (d > 1 or epochs > 1):
        # written once by stratum, so that a stratum reads its own rows only
        path = scratch_path(spark, "strata")
        tr.write.partitionBy("stratum").parquet(path)
        tr = spark.read.schema(tr.schema).parquet(path)
    learn, schema = _block_stream(k, gamma_u, gamma_i, lam, steps_per_row, scale, keys, trail)
    row_cols = keys + (order_names or ["user", "product", "rating"])
    # user, product and rating break ties: rows still equal are interchangeable
    order = list(dict.fromkeys(order_names + ["user", "product", "rating"]))
    stream_cols = [*keys, "g", "side", "id", "f", "user", "product", "rating"]
    facs = facs.select(*keys, "side", "id", "f")
    rest = None
    if n_rows is None and facs.count() * factor_row_bytes(k) > broadcast_max_bytes(spark):
        # A model too big for one task: only vectors of ids these rows touch
        # take part, so a micro-batch ships its own users/products, never
        # the whole model, to its block tasks.
        touched = materialize(
            tr.select(*keys, F.lit("u").alias("side"), F.col("user").alias("id"))
            .unionByName(tr.select(*keys, F.lit("p").alias("side"), F.col("product").alias("id")))
            .distinct())
        tb = broadcast_if_fits(touched, touched.count(), 48)
        rest = facs.join(tb, keys + ["side", "id"], "left_anti")
        facs = facs.join(tb, keys + ["side", "id"], "left_semi")
    for epoch in range(epochs):
        key = shuffle_key(row_cols, seed, epoch) if shuffle else F.lit(0).cast("long")
        for s in range(1 if alone else d):
            rows = (tr if alone else tr.where(F.col("stratum") == s)).withColumns({
                "_key": key, "side": F.lit(None).cast("string"), "f": no_vector(),
                "id": F.col(score_id) if score_id else F.lit(None).cast("long")})
            g = F.when(F.col("side") == "u", block_of("id", d)).otherwise(
                F.pmod(block_of("id", d) - F.lit(s), F.lit(d)))
            stream = rows.unionByName(facs.withColumn("g", g), allowMissingColumns=True)
            if alone:
                facs = (stream.withColumn("g", F.lit(0)).coalesce(1)
                        .sortWithinPartitions(F.col("side").desc_nulls_last(), "stratum", "_key", *order)
                        .select(*stream_cols).mapInArrow(learn, schema))
                continue
            # independent keyed models multiply the blocks; else a block is a partition
            dealt = stream.repartition(*keys, "g") if keys else stream.repartitionById(d, F.col("g"))
            facs = (dealt.sortWithinPartitions(*keys, "g", F.col("side").desc_nulls_last(), "_key", *order)
                    .select(*stream_cols).mapInArrow(learn, schema))
        # the strata of an epoch are the stages of one job
        facs = materialize(facs)
    if path is not None and epochs:
        delete_scratch(spark, path)
    seen = facs.where(~F.col("side").isin("u", "p")).withColumnRenamed("id", score_id or "id")
    facs = facs.where(F.col("side").isin("u", "p"))
    if rest is not None:
        facs = materialize(facs.unionByName(rest))
    if score_id is None:
        return facs
    return facs, _scores_of(seen, keys, score_id, trail)


def block_sgd(train: DataFrame, k: int, epochs: int, gamma_u: float, gamma_i: float,
              lam: float, uf: DataFrame | None = None, pf: DataFrame | None = None,
              blocks: int = config.GRID, order_cols: list[str] | None = None,
              steps_per_row: int = 1, shuffle: bool = True,
              seed: int = config.SEED, implicit: bool = False,
              keys: list[str] | None = None, n_rows: int | None = None):
    """L2: stratified SGD (Gemulla et al. 2011).

    Users and products are hashed into ``blocks`` groups each.  In stratum
    s the blocks (b, (b+s) mod d) share no user and no product, so the d
    blocks are trained in parallel, one task each, with the exact sequential
    update inside a block (vectorized by dependency waves, see
    ``sgd_sequence``).  Rows of a block are visited in a per-epoch
    pseudo-random order (``shuffle``) or in ``order_cols`` order (stream
    order).  blocks=1 is plain sequential SGD; with more blocks the rows of
    a call are visited stratum by stratum, and in the given order inside a
    block.  ``blocks`` is an argument, never derived from row counts: the
    result depends on it and on nothing of the cluster.  Choose it by the
    vectors: a task holds those of one user block and one product block.

    Data movement: the ratings are written once by stratum.  A stratum reads
    its own rows, and one exchange brings them and the vectors to their
    blocks, sorted as one stream: a block's vectors, then its ratings in
    visiting order.  The task streams over it with the vectors and a bounded
    buffer of ratings in memory (``_block_stream``), so its memory does not
    grow with the ratings, and gives back every vector: one checkpoint a
    stratum, no upsert joins.  A factor table above the broadcast limit is
    first split into the vectors of ids the rows touch and the rest, which
    is appended at the end.

    ``keys`` trains independent models side by side (factor tables keyed
    by keys + id; the group of a task is keys + block).  ``uf``/``pf``
    given: warm start; ids without a vector start from the deterministic
    init.  Returns (uf, pf)."""
    facs = combine_factors(uf, pf, train.sparkSession, keys)
    facs = block_sgd_table(train, facs, k, epochs, gamma_u, gamma_i, lam, blocks, order_cols,
                           steps_per_row, shuffle, seed, implicit, keys, n_rows=n_rows)
    return split_factors(facs, keys)


def distributed_sgd(train: DataFrame, k: int, epochs: int, gamma: float, lam: float,
                    blocks: int = config.GRID, **kw):
    """L3: one learning rate for both sides over conflict-free strata (the
    lock-free shared-store updates are replaced by a deterministic scheme)."""
    return block_sgd(train, k, epochs, gamma, gamma, lam, blocks=blocks, **kw)


def online_update(batch: DataFrame, uf: DataFrame, pf: DataFrame, k: int,
                  steps: int, gamma_u: float, gamma_i: float, lam: float,
                  order_cols: list[str], blocks: int = config.GRID, implicit: bool = False,
                  keys: list[str] | None = None, n_rows: int | None = None):
    """L4: learn a micro-batch of arrivals in stream order, ``steps``
    consecutive SGD steps per rating (no epoch shuffle); ``n_rows`` as in
    ``block_sgd_table``."""
    return block_sgd(batch, k, 1, gamma_u, gamma_i, lam, uf=uf, pf=pf, blocks=blocks,
                     order_cols=order_cols, steps_per_row=steps, shuffle=False,
                     implicit=implicit, keys=keys, n_rows=n_rows)


def score_and_learn(batch: DataFrame, facs: DataFrame, k: int, steps: int, gamma_u: float,
                    gamma_i: float, lam: float, order_cols: list[str], score_id: str = "idx",
                    blocks: int = config.GRID, implicit: bool = False,
                    keys: list[str] | None = None, trail: bool = False, batch_col: str | None = None,
                    dense: bool = False, n_rows: int | None = None):
    """Predict-then-learn on a micro-batch and a combined factor table:
    (table, scores).  Every row is scored by the vectors that the rows
    visited before it left, then learned; scores: (keys, score_id, score)
    and with ``trail`` (before, after) as in ``block_sgd_table``, as is ``n_rows``.

    With blocks=1 the visiting order is the stream order.  With more, rows
    are visited stratum by stratum, so a row may be scored after a later
    row of its own micro-batch, never of a later one.  With ``batch_col``,
    the number of a row's micro-batch, the rows may be those of many: they
    are learned as by one call a micro-batch (``_learn_rounds``; with
    ``dense``, for micro-batches whose rows share many users and products, by
    ``_learn_cells``)."""
    if batch_col is not None and dense:
        if keys or trail:
            raise ValueError("dense micro-batches have neither keys nor a trail")
        return _learn_cells(batch, facs, k, steps, gamma_u, gamma_i, lam, order_cols, score_id, blocks,
                            implicit, batch_col)
    if batch_col is not None:
        return _learn_rounds(batch, facs, k, steps, gamma_u, gamma_i, lam, order_cols, score_id, blocks,
                             implicit, keys, trail, batch_col)
    return block_sgd_table(batch, facs, k, 1, gamma_u, gamma_i, lam, blocks, order_cols, steps,
                           False, implicit=implicit, keys=keys, score_id=score_id, trail=trail,
                           restage=False, n_rows=n_rows)


# ---------------------------------------------------------------- many micro-batches at once

def _round_stream(k: int, gu: float, gi: float, lam: float, steps: int, scale: float, keys: list[str],
                  names: list[str], trail: bool, alone: bool):
    """One round of ``_learn_rounds`` on a partition, from one sorted stream.

    Rows come by (keys, g); of each user block first its users' vectors (kind
    'u'), then the product vectors that are its turn to use ('p'), then the
    ratings it has still to learn (kind null) in visiting order.  A rating is
    learned if its product's vector is here and no earlier rating of its user
    waits; a product's vector then goes to the block of its ``next`` rating.
    ``alone``: there is one block, which learns every rating.
    Leave: scores ('r', and 'b', 'a' as in ``_block_stream``), finished vectors
    ('U', 'P'), and what the next round starts from ('u', 'p', null)."""
    at = len(keys)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, layout = None, [], 0, None
        U = P = here = stuck = due = to = None

        def out(kind: str, ids: np.ndarray, vectors: np.ndarray, g=None) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(ids), BUFFER_ROWS):
                part, f = ids[a:a + BUFFER_ROWS], vectors[a:a + BUFFER_ROWS]
                n = len(part)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * f.shape[1])
                block = np.full(n, key[at]) if g is None else g[a:a + BUFFER_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, v, np.int64)) for v in key[:at]]
                    + [pa.array(block, pa.int32()), pa.array([kind] * n), pa.array(part, pa.int64()),
                       pa.ListArray.from_arrays(offsets, pa.array(f.ravel())).cast(layout.field("f").type)]
                    + [pa.nulls(n, t) for t in layout.types[at + 4:]], schema=layout)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            if not held:
                return
            rows = pa.Table.from_batches(held)
            held, n_held = [], 0
            users, products, goes = (rows[c].to_numpy() for c in ("user", "product", "next"))
            if not alone:
                ready = np.zeros(rows.num_rows, bool)
                for j, (a, b, to_) in enumerate(zip(users.tolist(), products.tolist(), goes.tolist())):
                    if b in here and a not in stuck:
                        ready[j] = True
                        if to_ != key[at]:
                            here.remove(b)
                    else:
                        stuck.add(a)
                        due.add(b)
                        here.discard(b)
                if not ready.all():
                    for left in rows.filter(pa.array(~ready)).select(names).to_batches():
                        yield pa.RecordBatch.from_arrays(left.columns, schema=layout)
                    rows = rows.filter(pa.array(ready))
                    users, products, goes = users[ready], products[ready], goes[ready]
                if not rows.num_rows:
                    return
                to.update(zip(products.tolist(), goes.tolist()))
            path = (np.empty((rows.num_rows, k)), np.empty((rows.num_rows, k))) if trail else None
            scores = sgd_sequence(users, products, rows["rating"].to_numpy(), U, P, steps, gu, gi, lam, path)
            wanted = rows["id"].is_valid().to_numpy()
            if wanted.any():
                ids = rows["id"].drop_null().to_numpy()
                yield from out("r", ids, scores[wanted][:, None])
                for kind, vectors in zip("ba", path or ()):
                    yield from out(kind, ids, vectors[wanted])

        def close() -> Iterator[pa.RecordBatch]:
            yield from flush()
            ids = np.fromiter(U.at, np.int64, len(U.at))
            waits = np.fromiter((i in stuck for i in U.at), bool, len(ids))
            for kind, mine in (("u", waits), ("U", ~waits)):
                yield from out(kind, ids[mine], U.f[:len(ids)][mine])
            ids = np.fromiter(P.at, np.int64, len(P.at))
            # to the block of its next rating; none is left where it stays and nothing waits
            goes = np.fromiter((to.get(i, key[at]) for i in P.at), np.int32, len(ids))
            goes[(goes == key[at]) & ~np.fromiter((i in due for i in P.at), bool, len(ids))] = -1
            for kind, mine in (("p", goes >= 0), ("P", goes < 0)):
                yield from out(kind, ids[mine], P.f[:len(ids)][mine], goes[mine])

        for batch in batches:
            # all batches leave with one schema, every column nullable
            layout = layout or pa.schema([(c, batch.schema.field(c).type) for c in names])
            of = np.stack([batch.column(c).to_numpy() for c in keys + ["g"]])
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                now = tuple(int(v) for v in of[:, lo])
                if now != key:
                    if key is not None:
                        yield from close()
                    key = now
                    U, P = Vectors(k, config.USER_SALT, scale), Vectors(k, config.PRODUCT_SALT, scale)
                    here, stuck, due, to = set(), set(), set(), {}
                part = batch.slice(lo, hi - lo)
                for name, V in (("u", U), ("p", P)):
                    mine = part.filter(pc.fill_null(pc.equal(part.column("kind"), name), False))
                    known = pc.greater(pc.list_value_length(mine.column("f")), 0)
                    old = mine.filter(known)
                    if old.num_rows:
                        V.put(old.column("id").to_numpy().tolist(),
                              old.column("f").flatten().to_numpy().reshape(old.num_rows, k))
                    if mine.num_rows > old.num_rows:
                        V.rows(mine.filter(pc.invert(known)).column("id").to_numpy())
                    if name == "p":
                        here.update(mine.column("id").to_numpy().tolist())
                rows = part.filter(part.column("kind").is_null())
                if rows.num_rows:
                    held.append(rows)
                    n_held += rows.num_rows
                    if n_held >= BUFFER_ROWS:
                        yield from flush()
        if key is not None:
            yield from close()

    return learn


def _learn_rounds(rows: DataFrame, facs: DataFrame, k: int, steps: int, gamma_u: float, gamma_i: float,
                  lam: float, order_cols: list[str], score_id: str, blocks: int, implicit: bool,
                  keys: list[str] | None, trail: bool, batch_col: str):
    """``score_and_learn`` of many micro-batches, with the result of one call
    a micro-batch.

    A rating depends on nothing but the earlier ratings of its user and its
    product, so strata and micro-batches need not wait for each other.  Each
    user block is a task that keeps its users; a product's vector goes from
    block to block along the product's ratings in visiting order
    (micro-batch, stratum, ``order_cols``).  In a round every block learns all
    it can with the vectors it has; what is left, with the vectors on their
    way, opens the next round.  Where ratings share few users and products, a
    round learns most of what is open.  Where a round learns less than half,
    chains of ratings change blocks too often, and the next one has a quarter
    of the blocks; a single block learns all that is left.  So the rounds are
    at most some log2(rows), whatever the data.  Keyed models have one block
    each.  Only vectors of ids the rows touch move, and the table is merged
    once.  A task holds the vectors of its block (of ``rows`` at most) and a
    buffer of ratings."""
    spark = rows.sparkSession
    keys = list(keys or [])
    d = max(1, int(blocks))
    scale = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    order = list(dict.fromkeys([*order_cols, "user", "product", "rating"]))
    # independent keyed models are the blocks
    left, parts = rows.count(), 1 if keys else d
    g = block_of("user", d)
    stratum = F.pmod(block_of("product", d) - g, F.lit(d))
    tr = rows.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in
                              (("user", "long"), ("product", "long"), ("rating", "double"))],
                     *[c for c in order_cols if c not in (*keys, "user", "product", "rating")],
                     F.col(score_id).cast("long").alias("id"), F.col(batch_col).alias("_batch"))
    # rows without a user or product are in no stratum
    tr = tr.withColumn("g", g).withColumn("turn", F.col("_batch") * d + stratum).where("turn IS NOT NULL")
    tr = tr.drop("_batch")
    if parts > 1:
        visits = Window.partitionBy("product").orderBy("turn", *order)
        tr = tr.withColumns({"next": F.coalesce(F.lead("g").over(visits), F.lit(-1)),
                             "nth": F.row_number().over(visits)})
    else:
        tr = tr.withColumns({"g": F.lit(0), "next": F.lit(0), "nth": F.lit(1)})
    names = [*keys, "g", "kind", "id", "f", "user", "product", "rating", "next", "turn", "nth",
             *[c for c in order if c not in ("user", "product", "rating", *keys)]]
    touched = tr.select(*keys, "g", F.lit("u").alias("kind"), F.col("user").alias("id")).distinct().unionByName(
        tr.where("nth = 1").select(*keys, "g", F.lit("p").alias("kind"), F.col("product").alias("id")).distinct())
    given = touched.join(facs.select(*keys, F.col("side").alias("kind"), "id", "f"), [*keys, "kind", "id"], "left")
    open_ = tr.withColumns({"kind": F.lit(None).cast("string"), "f": no_vector()}).unionByName(
        given.withColumn("f", F.coalesce("f", no_vector())), allowMissingColumns=True).select(*names)
    schema = T.StructType([T.StructField(c.name, c.dataType) for c in open_.schema])
    kind = F.col("kind")
    part = (F.when(kind.isin("U", "P"), "model").when(kind.isin("r", "b", "a"), "seen").otherwise("open"))
    root, done = scratch_path(spark, "rounds"), 0
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(number, name: str) -> str:
        return f"{root}/round={number}/part={name}"

    def held(name: str) -> DataFrame:
        found = [folder(j, name) for j in range(done)
                 if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder(j, name)))]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    while open_ is not None:
        learn = _round_stream(k, gamma_u, gamma_i, lam, steps, scale, keys, names, trail, parts == 1)
        dealt = open_.repartition(*keys) if keys else open_.repartitionById(parts, F.col("g"))
        dealt.sortWithinPartitions(*keys, "g", F.col("kind").desc_nulls_last(), "turn", *order, "nth").mapInArrow(
            learn, schema).withColumn("part", part).write.partitionBy("part").parquet(f"{root}/round={done}")
        if done:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder(done - 1, "open")), True)
        done += 1
        open_ = None
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder(done - 1, "open"))):
            open_ = spark.read.schema(schema).parquet(folder(done - 1, "open"))
            before, left = left, open_.where("kind IS NULL").count()
            if 2 * left > before:
                fewer = min(parts, 4)
                parts = -(-parts // fewer)
                open_ = open_.withColumns({c: F.floor(F.col(c) / F.lit(fewer)).cast("int") for c in ("g", "next")})
    fresh = held("model").select(*keys, F.lower("kind").alias("side"), "id", F.col("f").alias("new"))
    facs = materialize(facs.select(*keys, "side", "id", "f").join(fresh, [*keys, "side", "id"], "full").select(
        *keys, "side", "id", F.coalesce("new", "f").alias("f")))
    for j in range(done):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder(j, "model")), True)
    seen = held("seen").withColumnRenamed("kind", "side").select(*keys, F.col("id").alias("_scored"), "side", "f")
    seen = seen.withColumnRenamed("_scored", score_id)
    return facs, _scores_of(seen, keys, score_id, trail)


def _scores_of(seen: DataFrame, keys: list[str], score_id: str, trail: bool) -> DataFrame:
    if not trail:
        return seen.select(*keys, score_id, F.col("f")[0].alias("score"))
    f = {side: F.max(F.when(F.col("side") == side, F.col("f"))) for side in "rba"}
    return seen.groupBy(*keys, score_id).agg(
        f["r"][0].alias("score"), f["b"].alias("before"), f["a"].alias("after"))


# ---------------------------------------------------------------- dense micro-batches

PACKED_VALUES = 1 << 19      # numbers in a list of a packed row
JOB_BATCHES = 4              # micro-batches learned in one job
CLEAN_EVERY = 2              # jobs between two clean-ups of shuffle files
PACKED_SCHEMA = T.StructType([
    T.StructField("g", T.IntegerType()),
    T.StructField("side", T.StringType()),
    T.StructField("stratum", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("f", T.ArrayType(T.DoubleType())),
    T.StructField("users", T.ArrayType(T.LongType())),
    T.StructField("products", T.ArrayType(T.LongType())),
    T.StructField("level", T.ArrayType(T.LongType())),
])
CELL_SCHEMA = T.StructType([*PACKED_SCHEMA.fields, T.StructField("batch_", T.LongType())])


def _packed_row(g: int, side: str | None, ids, f, users=None, products=None, level=None,
                stratum: int | None = None, seq: int = 0, batch: int | None = None) -> pa.RecordBatch:
    """One packed row: lists of ids and numbers, and of a cell its users, products and waves."""
    def one(values, kind: pa.DataType) -> pa.Array:
        if values is None:
            return pa.nulls(1, pa.list_(kind))
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [pa.array([g], pa.int32()), pa.array([side], pa.string()), pa.array([stratum], pa.int32()),
               pa.array([seq], pa.int64()), one(ids, pa.int64()), one(f, pa.float64()), one(users, pa.int64()),
               one(products, pa.int64()), one(level, pa.int64())]
    if batch is not None:
        columns.append(pa.array([batch], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, (PACKED_SCHEMA if batch is None else CELL_SCHEMA).names)


def _packed_vectors(g: int, side: str, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = max(1, PACKED_VALUES // vectors.shape[1])
    for a in range(0, len(ids), size):
        yield _packed_row(g, side, ids[a:a + size], vectors[a:min(a + size, len(ids))].ravel())


def _pack_factors(k: int):
    """Vectors (g, side, id, f), g of the partition -> packed rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, side = batch.column("g").to_numpy(), batch.column("side").to_numpy(zero_copy_only=False)
            for g in np.unique(of):
                for s in "up":
                    mine = batch.filter(pa.array((of == g) & (side == s)))
                    if mine.num_rows:
                        yield from _packed_vectors(int(g), s, mine.column("id").to_numpy(),
                                                   mine.column("f").flatten().to_numpy().reshape(mine.num_rows, k))

    return pack


def _pack_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratings sorted by (batch_, stratum, g) and visiting order -> packed rows
    of at most BUFFER_ROWS ratings, each in the order of its waves, which
    depend on no vector and so are found here, for all micro-batches at once."""
    key, held, n_held, seq = None, [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n_held, seq
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            level = wave_levels(rows["user"].to_numpy(), rows["product"].to_numpy())
            order = np.argsort(level, kind="stable")
            rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
            yield _packed_row(key[2], None, rows.column("id"), rows.column("rating"), rows.column("user"),
                              rows.column("product"), level[order], key[1], seq, key[0])
            held, n_held, seq = [], 0, seq + 1

    for batch in batches:
        of = np.stack([batch.column(c).to_numpy() for c in ("batch_", "stratum", "g")])
        cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi == lo:
                continue
            now = tuple(int(v) for v in of[:, lo])
            if now != key:
                yield from flush()
                key, seq = now, 0
            for a in range(lo, hi, BUFFER_ROWS):
                part = batch.slice(a, min(BUFFER_ROWS, hi - a))
                if n_held + part.num_rows > BUFFER_ROWS:
                    yield from flush()
                held.append(part.select(["id", "user", "product", "rating"]))
                n_held += part.num_rows
    yield from flush()


def _cell_stream(k: int, gu: float, gi: float, lam: float, steps: int, scale: float, d: int, s: int):
    """Learns one cell (micro-batch, stratum ``s``, user block): a partition with
    the packed vectors of a user block and of the product block that is its
    turn, then the packed ratings.  Those of later strata wait.  Products leave
    for the user block that meets them in the next stratum, the one before this."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cell = None, []
        V = {"u": Vectors(k, config.USER_SALT, scale), "p": Vectors(k, config.PRODUCT_SALT, scale)}
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1)
                g, side = row.column("g")[0].as_py(), row.column("side")[0].as_py()
                if side in V:
                    V[side].put(row.column("ids").flatten().to_numpy().tolist(),
                                row.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                elif side is None and row.column("stratum")[0].as_py() == s:
                    cell.append(row)
                else:
                    yield row.select(PACKED_SCHEMA.names)
        for row in sorted(cell, key=lambda r: r.column("seq")[0].as_py()):
            ids, f, users, products, level = (row.column(c).flatten() for c in ("ids", "f", "users", "products", "level"))
            scores = sgd_sequence(users.to_numpy(), products.to_numpy(), f.to_numpy(zero_copy_only=False), V["u"],
                                  V["p"], steps, gu, gi, lam, level=level.to_numpy())
            wanted = ids.is_valid().to_numpy(zero_copy_only=False)
            if wanted.any():
                yield _packed_row(g, "r", ids.drop_null(), scores[wanted])
        for side, to in (("u", g), ("p", None if g is None else (g - 1) % d)):
            ids = np.fromiter(V[side].at, np.int64, len(V[side].at))
            yield from _packed_vectors(to, side, ids, V[side].f)

    return learn


def _unpack(width: int):
    """Packed rows -> (side, id, f), ``width`` numbers each."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1)
                ids = row.column("ids").flatten()
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width),
                                             row.column("f").flatten())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column("side")[0].as_py()] * len(ids), pa.string()), ids, f], ["side", "id", "f"])

    return unpack


def _learn_cells(rows: DataFrame, facs: DataFrame, k: int, steps: int, gamma_u: float, gamma_i: float,
                 lam: float, order_cols: list[str], score_id: str, blocks: int, implicit: bool,
                 batch_col: str):
    """``score_and_learn`` of many micro-batches, one stratum after the other,
    with the result of one call a micro-batch.

    Where most ratings of a micro-batch hang together (replays), no rounds can
    run ahead of the strata (``_learn_rounds``), and what a stratum costs is
    the handling of its rows.  So everything that does not depend on the
    vectors is done first, for all micro-batches in parallel: ratings are
    dealt to their cells (micro-batch, stratum, user block), sorted, put in
    waves and packed, a list a column.  Vectors are packed likewise, a block a
    few rows.  Then a stratum is a stage of ``blocks`` tasks that exchange
    whole lists, and JOB_BATCHES micro-batches are one job.  Vectors of ids
    that no row touches stay out, and the table is merged once.  A task holds
    the vectors of its two blocks and the ratings of a cell."""
    spark = rows.sparkSession
    d = max(1, int(blocks))
    scale = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    order = list(dict.fromkeys([*order_cols, "user", "product", "rating"]))
    g = block_of("user", d)
    tr = rows.select(*[F.col(c).cast(t).alias(c) for c, t in
                       (("user", "long"), ("product", "long"), ("rating", "double"))],
                     *[c for c in order_cols if c not in ("user", "product", "rating")],
                     F.col(score_id).cast("long").alias("id"), F.col(batch_col).cast("long").alias("batch_"))
    # rows without a user or product are in no stratum
    tr = tr.withColumns({"g": g, "stratum": F.pmod(block_of("product", d) - g, F.lit(d))}).where("stratum IS NOT NULL")
    root = scratch_path(spark, "cells")
    # a fixed number of parts: by size alone they would be a few long tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tr.repartition(parts, "batch_", "g").sortWithinPartitions("batch_", "stratum", "g", *order)
     .mapInArrow(_pack_cells, CELL_SCHEMA).write.partitionBy("batch_").parquet(f"{root}/cells"))
    cells = spark.read.schema(CELL_SCHEMA).parquet(f"{root}/cells")
    # one row a micro-batch
    numbers = [r[0] for r in cells.select("batch_").distinct().orderBy("batch_").collect()]
    facs = facs.select("side", "id", "f")
    touched = materialize(tr.select(F.lit("u").alias("side"), F.col("user").alias("id")).distinct().unionByName(
        tr.select(F.lit("p").alias("side"), F.col("product").alias("id")).distinct()))
    mine = facs.join(touched, ["side", "id"], "left_semi").withColumn("g", block_of("id", d))
    model = mine.repartitionById(d, F.col("g")).select("g", "side", "id", "f").mapInArrow(
        _pack_factors(k), PACKED_SCHEMA)
    learn = [_cell_stream(k, gamma_u, gamma_i, lam, steps, scale, d, s) for s in range(d)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def held(part: str, of: list[int]) -> DataFrame:
        found = [f"{root}/job={j}/part={part}" for j in of]
        found = [p for p in found if fs.exists(path(p))]
        return spark.read.schema(PACKED_SCHEMA).parquet(*found) if found else spark.createDataFrame([], PACKED_SCHEMA)

    jobs = [numbers[a:a + JOB_BATCHES] for a in range(0, len(numbers), JOB_BATCHES)]
    for j, job in enumerate(jobs):
        for m in job:
            model = model.unionByName(cells.where(F.col("batch_") == m).select(*PACKED_SCHEMA.names))
            for s in range(d):
                model = model.repartitionById(d, F.col("g")).mapInArrow(learn[s], PACKED_SCHEMA)
        part = F.when(F.col("side") == "r", "seen").otherwise("model")
        # the plan is fixed: nothing of it is left to decide while it runs
        with without_adaptive(spark):
            model.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/job={j}")
        if j:
            fs.delete(path(f"{root}/job={j - 1}/part=model"), True)
        model = held("model", [j])
        if j % CLEAN_EVERY == CLEAN_EVERY - 1:
            spark._jvm.System.gc()
    fs.delete(path(f"{root}/cells"), True)
    unpacked = T.StructType([T.StructField("side", T.StringType()), *FACTOR_SCHEMA.fields])
    last = [len(jobs) - 1] if jobs else []
    fresh = held("model", last).select("side", "ids", "f").mapInArrow(_unpack(k), unpacked)
    facs = materialize(facs.join(fresh.withColumnRenamed("f", "new"), ["side", "id"], "full").select(
        "side", "id", F.coalesce("new", "f").alias("f")))
    for j in last:
        fs.delete(path(f"{root}/job={j}/part=model"), True)
    seen = held("seen", list(range(len(jobs)))).select("side", "ids", "f").mapInArrow(_unpack(1), unpacked)
    return facs, seen.select(F.col("id").alias(score_id), F.col("f")[0].alias("score"))


# ---------------------------------------------------------------- L5

def replay_rows(buffers: DataFrame, passes: int = config.REPLAY_PASSES, idx: str = "idx"):
    """W5 buffers -> learning rows (event, step, user, product, rating), with
    ``scored`` = the event on its first step (its own rating) and null else."""
    from factorcast.operators.history import replay_sequence
    return replay_sequence(buffers, passes, idx).select(
        F.col(idx).alias("event"), "step", "user", F.col("b_product").alias("product"),
        F.col("b_rating").alias("rating")).withColumn(
        "scored", F.when(F.col("step") == 0, F.col("event")))


def last_k_replay(events: DataFrame, k: int, last_k: int, gamma_u: float, gamma_i: float,
                  lam: float, uf: DataFrame | None = None, pf: DataFrame | None = None,
                  idx: str = "idx", passes: int = config.REPLAY_PASSES, blocks: int = config.GRID,
                  implicit: bool = False):
    """For each event (in ``idx`` order) the user's ``last_k`` newest
    ratings, current included, are replayed newest to oldest ``passes``
    times with one SGD step each.

    The replay rows are generated declaratively (W5 buffer join + W6
    explode) and learned in (idx, step) order; blocks=1 reproduces the
    sequential semantics exactly, blocks>1 visits them stratum by stratum."""
    from factorcast.operators.history import last_k_buffer
    rows = replay_rows(last_k_buffer(events, last_k, idx), passes, idx)
    return block_sgd(rows, k, 1, gamma_u, gamma_i, lam, uf=uf, pf=pf, blocks=blocks,
                     order_cols=["event", "step"], shuffle=False, implicit=implicit)


# ---------------------------------------------------------------- L6

FOLD_CHUNK_CONF = "factorcast.foldChunkRows"
DEFAULT_FOLD_CHUNK = 1 << 20
FOLD_BUFFER = 1 << 14        # maps composed at once in a task


def affine_steps(pf: np.ndarray, ratings: np.ndarray, steps: int, gamma: float, lam: float) -> np.ndarray:
    """What learning a rating with a frozen product vector p does to the user
    vector, as (k+1) x (k+1) matrices on (v, 1): one step is
    v -> (1 - gamma lam) v - gamma (v.p) p + gamma r p, an affine map."""
    n, k = pf.shape
    maps = np.zeros((n, k + 1, k + 1))
    maps[:, :k, :k] = -gamma * pf[:, :, None] * pf[:, None, :]
    maps[:, np.arange(k), np.arange(k)] += 1.0 - gamma * lam
    maps[:, :k, k] = gamma * ratings[:, None] * pf
    maps[:, k, k] = 1.0
    out = maps
    for _ in range(steps - 1):
        out = maps @ out
    return out if steps > 0 else np.tile(np.eye(k + 1), (n, 1, 1))


def compose_runs(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The product of the maps of each run [starts[i], starts[i+1]), the later
    map outside.  Neighbours are multiplied pairwise (the product is
    associative), all runs at once, so the loop takes log2(longest) rounds."""
    lengths = np.diff(np.r_[starts, len(maps)])
    while len(maps) > len(lengths):
        first = np.cumsum(lengths) - lengths
        at = np.arange(len(maps)) - np.repeat(first, lengths)
        even = np.flatnonzero(at % 2 == 0)
        paired = at[even] + 1 < np.repeat(lengths, lengths)[even]
        new = maps[even]
        new[paired] = maps[even[paired] + 1] @ new[paired]
        maps, lengths = new, (lengths + 1) // 2
    return maps


def _compose_stream(k: int, keys: list[str], read) -> tuple:
    """Composes the maps of consecutive rows with equal ``keys`` (the rows come
    sorted); ``read(batch)`` gives their maps.  A run may go on over any
    number of batches; a task holds FOLD_BUFFER maps."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in keys]
                          + [T.StructField("map", T.ArrayType(T.DoubleType()))])
    width = (k + 1) ** 2

    def out(key: np.ndarray, maps: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(maps) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in key] + [pa.ListArray.from_arrays(offsets, pa.array(maps.ravel()))],
            [f.name for f in schema.fields])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_map = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, FOLD_BUFFER):
                batch = whole.slice(lo, FOLD_BUFFER)
                key = np.stack([batch.column(c).to_numpy() for c in keys])
                starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
                key, maps = key[:, starts], compose_runs(read(batch), starts)
                if open_key is not None and (key[:, 0] == open_key).all():
                    maps[0] = maps[0] @ open_map
                elif open_key is not None:
                    yield out(open_key[:, None], open_map[None])
                if len(maps) > 1:
                    yield out(key[:, :-1], maps[:-1])
                open_key, open_map = key[:, -1], maps[-1]
        if open_key is not None:
            yield out(open_key[:, None], open_map[None])

    return compose, schema


def user_fold_in(events: DataFrame, uf: DataFrame | None, pf: DataFrame, k: int,
                 steps: int, gamma_u: float, lam: float, order_cols: list[str],
                 implicit: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Exact per-user sequential update of the user vectors with the
    product vectors frozen (as at the start of the batch).

    A step with a frozen product vector is an affine map of the user vector,
    and affine maps compose associatively.  So a user's sequence is cut into
    chunks that are composed in different tasks, and the few chunk maps of a
    user are composed again and applied to the start vector: a user with a
    third of all rows is no single task.  Only users with more than
    ``factorcast.foldChunkRows`` events are cut, at every so many rows of the
    (user, order) sequence of such users.
    Returns the updated user factor rows (users of ``events`` only); events
    of a product without a vector use its start vector."""
    spark = events.sparkSession
    chunk_rows = int(spark.conf.get(FOLD_CHUNK_CONF, str(DEFAULT_FOLD_CHUNK)))
    ev = events.select(F.col("user").cast("long").alias("user"),
                       F.col("product").cast("long").alias("product"),
                       F.col("rating").cast("double").alias("rating"), *order_cols)
    # hot users: at most rows / chunk_rows of them
    hot = materialize(ev.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows))
    n_hot = hot.count()
    if n_hot:
        ev = ev.join(broadcast_if_fits(hot.select("user", F.lit(True).alias("hot")), n_hot, 32),
                     "user", "left")
        own = global_index(ev.where("hot"), ["user", *order_cols], "at")
        ev = (own.withColumn("chunk", F.floor(F.col("at") / chunk_rows).cast("long")).drop("at")
              .unionByName(ev.where("hot IS NULL").withColumn("chunk", F.lit(0).cast("long"))))
    else:
        ev = ev.withColumn("chunk", F.lit(0).cast("long"))
    made = init_product_factor("product", k, implicit)
    j = ev.join(pf.select(F.col("id").alias("product"), F.col("f").alias("pf")), "product", "left").select(
        "user", "chunk", "rating", F.coalesce("pf", made).alias("pf"), *order_cols)
    keyed = (j.repartition(num_partitions, "user", "chunk") if num_partitions
             else j.repartition("user", "chunk"))

    def of_ratings(batch: pa.RecordBatch) -> np.ndarray:
        p = batch.column("pf").flatten().to_numpy().reshape(batch.num_rows, k)
        return affine_steps(p, batch.column("rating").to_numpy(), steps, gamma_u, lam)

    def of_maps(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("map").flatten().to_numpy().reshape(batch.num_rows, k + 1, k + 1).copy()

    by_chunk, schema = _compose_stream(k, ["user", "chunk"], of_ratings)
    chunks = keyed.sortWithinPartitions("user", "chunk", *order_cols).select(
        "user", "chunk", "rating", "pf").mapInArrow(by_chunk, schema)
    by_user, schema = _compose_stream(k, ["user"], of_maps)
    maps = chunks.repartition("user").sortWithinPartitions("user", "chunk").select(
        "user", "map").mapInArrow(by_user, schema)
    old = None if uf is None else uf.select(F.col("id").alias("user"), F.col("f").alias("uf"))
    maps = maps.withColumn("uf", F.lit(None).cast("array<double>")) if old is None else maps.join(
        old, "user", "left")
    v, m = F.coalesce("uf", init_user_factor("user", k, implicit)).alias("v"), F.col("map")
    new = [reduce(lambda x, y: x + y, [m[i * (k + 1) + c] * F.col("v")[c] for c in range(k)])
           + m[i * (k + 1) + k] for i in range(k)]
    return maps.select("user", "map", v).select(F.col("user").alias("id"), F.array(*new).alias("f"))
