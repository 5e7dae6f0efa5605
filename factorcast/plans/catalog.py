"""Registered queries: name -> (spark, sf_dir) -> DataFrame, each next to
its oracle SQL (DuckDB dialect) when one exists.

Inputs are always the whole derived tables (``ratings`` from lineitem x
orders, ``feedback`` from events).  Parameters are fixed here so the
Spark and SQL sides agree; every DOUBLE output is rounded to 6 places on
both sides.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorcast import config
from factorcast.functions import vectors as V
from factorcast.operators import history as H
from factorcast.operators import metrics as M
from factorcast.operators import ordering as OR
from factorcast.operators import recommend as RC
from factorcast.operators.recall import recall_at_events
from factorcast.operators import train as TR
from factorcast.operators.train import batch_gd
from factorcast.plans import oracle as O
from factorcast.plans import protocols as P
from factorcast.session import materialize
from factorcast.sources import csv as CSV
from factorcast.sources import factors as FA
from factorcast.sources import sinks as SK
from factorcast.sources import tables as S
from factorcast.sources.store import factor_store

K = 8
EPOCHS = 2
GAMMA = 0.05
LAMBDA = 0.02
LAST_K = 3
TOP_R = 5
ROUND_ROWS = 1000
RECALL_ROUND = config.RECALL_ROUND
KEYS = ["okey", "line", "product", "supp"]
QU = '"user"'

QUERIES: dict = {}
ORACLE: dict = {}
# SQL of sequential learning: one recursion step per stratum position, some
# 7 ms each, so 60,000 ratings take minutes.  The tests run it at sf0.001.
SEQUENTIAL_SQL: dict = {}


def register(name: str, sql: str | None = None, sequential: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if sequential is not None:
            SEQUENTIAL_SQL[name] = sequential
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column (the oracle rounds the same columns)."""
    cols = [F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def W(ctes: list[str], body: str) -> str:
    recursive = any("USING KEY" in c or c.startswith("fold(") for c in ctes)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def fcols(alias: str = "", k: int = K, prefix: str = "f") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(r6(f"{a}f{j}", f"{prefix}{j}") for j in range(k))


# ------------------------------------------------------------ shared pieces

def _ratings(spark, sf):
    return S.ratings(spark, sf)


def _split(spark, sf):
    return OR.holdout_split(_ratings(spark, sf), S.RATINGS_HASH_KEY)


def _train_test(spark, sf):
    s = _split(spark, sf)
    return s.where(F.col("is_train")), s.where(~F.col("is_train"))


def _first_block(spark, sf):
    """(the ratings of time block 0, all ratings)."""
    ix = OR.global_index(_ratings(spark, sf), S.RATINGS_ORDER)
    return OR.time_blocks(ix, ix.count()).where(F.col("block") == 0), ix


def _init_from(df, implicit=False):
    return (FA.init_factors(df, "user", K, "user", implicit),
            FA.init_factors(df, "product", K, "product", implicit))


def _feedback_indexed(spark, sf):
    return OR.global_index(S.feedback(spark, sf), S.FEEDBACK_ORDER)


def _factor_out(df, side=None):
    cols = ([F.lit(side).alias("side")] if side else []) + [F.col("id")] + V.unpack("f", K, "f")
    return df.select(*cols)


SQL_R = [f"r AS ({O.RATINGS})"]
SQL_RS = SQL_R + [
    f"s AS (SELECT *, {O.split_flag(KEYS)} AS is_train FROM r)",
    "tr AS (SELECT * FROM s WHERE is_train)",
    "te AS (SELECT * FROM s WHERE NOT is_train)",
]
SQL_INIT_TR = [
    f"u0 AS ({O.init_table('tr', QU, K, config.USER_SALT, config.SCALE_EXPLICIT)})",
    f"p0 AS ({O.init_table('tr', 'product', K, config.PRODUCT_SALT, config.SCALE_EXPLICIT)})",
]
SQL_INIT_ALL = [
    f"ua AS ({O.init_table('r', QU, K, config.USER_SALT, config.SCALE_EXPLICIT)})",
    f"pa AS ({O.init_table('r', 'product', K, config.PRODUCT_SALT, config.SCALE_EXPLICIT)})",
]
SQL_FB = [
    f"fb AS ({O.FEEDBACK})",
    "fi AS (SELECT *, CAST(row_number() OVER (ORDER BY ts, seq) - 1 AS BIGINT) AS idx FROM fb)",
]
SQL_FB_INIT = [
    f"ui AS ({O.init_table('fb', QU, K, config.USER_SALT, config.SCALE_IMPLICIT)})",
    f"pi AS ({O.init_table('fb', 'product', K, config.PRODUCT_SALT, config.SCALE_IMPLICIT)})",
    f"sc AS (SELECT u.id AS {QU}, p.id AS product, {' + '.join(f'u.f{j} * p.f{j}' for j in range(K))} AS score "
    "FROM ui u CROSS JOIN pi p)",
]
SQL_IX = [
    "ix AS (SELECT *, CAST(row_number() OVER (ORDER BY ts, okey, line, product, supp) - 1 AS BIGINT) AS idx FROM r)",
    "nn AS (SELECT count(*) AS n FROM r)",
    f"ed AS (SELECT CAST(range AS BIGINT) AS block, CAST(floor(n / {O.dbl(config.N_BLOCKS)} * range) AS BIGINT) AS lo, "
    f"CAST(floor(n / {O.dbl(config.N_BLOCKS)} * (range + 1)) AS BIGINT) AS hi FROM nn, range(0, {config.N_BLOCKS}))",
    "ib AS (SELECT ix.*, ed.block FROM ix LEFT JOIN ed ON ix.idx >= ed.lo AND ix.idx < ed.hi)",
]
# a model of time block 0 only meets every rating: most users and products have no vector
SQL_T0 = SQL_R + SQL_IX + ["tr AS (SELECT * FROM ib WHERE block = 0)", "te AS (SELECT * FROM ix)"]
DOT_UP = " + ".join(f"u.f{j} * p.f{j}" for j in range(K))
SQL_KEYS = "x.okey, x.line, x.product, x.supp"


# ------------------------------------------------------------ sources / sinks

def _days(ts):
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date"))


SQL_DAYS = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


@register("src_ratings", W(SQL_R, f"SELECT CAST({QU} AS INTEGER) AS {QU}, CAST(product AS INTEGER) AS product, "
                                  f"CAST(CAST(rating AS FLOAT) AS DOUBLE) AS rating, "
                                  f"CAST({SQL_DAYS} AS INTEGER) AS timestamp FROM r"))
def q_src_ratings(spark, sf):
    r = _ratings(spark, sf).select("user", "product", "rating", _days("ts").alias("timestamp"))
    path = SK.scratch_path(spark, "ratings-csv")
    CSV.write_ratings(r, path)
    d = CSV.read_ratings(spark, path)
    return d.select("user", "product", F.col("rating").cast("double").alias("rating"), "timestamp")


@register("casts_and_split", ORACLE["src_ratings"])
def q_casts_and_split(spark, sf):
    r = _ratings(spark, sf).select("user", "product", "rating", _days("ts").alias("timestamp"))
    path = SK.scratch_path(spark, "ratings-text")
    CSV.write_ratings(r, path)
    lines = spark.read.text(path)
    d = CSV.parse_lines(lines, CSV.RATINGS_FIELDS, F.lit(path))
    return d.select("user", "product", F.col("rating").cast("double").alias("rating"), "timestamp")


def _secs(ts):
    return (_days(ts).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts)).cast("long")


@register("src_feedback", W(SQL_FB, f"SELECT CAST({QU} AS INTEGER) AS {QU}, product, rating, "
                                    f"CAST({SQL_DAYS} AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 "
                                    "+ second(ts) AS timestamp FROM fb"))
def q_src_feedback(spark, sf):
    fb = S.feedback(spark, sf).select("code", "user", "product", _secs("ts").alias("timestamp"))
    path = SK.scratch_path(spark, "feedback-csv")
    CSV.write_feedback(fb, path)
    d = CSV.read_feedback(spark, path)
    return rounded(d.select("user", "product", "rating", "timestamp"))


@register("factors_get", W(SQL_T0 + SQL_INIT_TR,
                           f"SELECT {SQL_KEYS}, x.{QU}, {r6('u.f0', 'uf0')}, {r6('p.f0', 'pf0')} "
                           f"FROM te x LEFT JOIN u0 u ON x.{QU} = u.id LEFT JOIN p0 p ON x.product = p.id"))
def q_factors_get(spark, sf):
    tr, te = _first_block(spark, sf)
    uf, pf = _init_from(tr)
    j = FA.lookup_factors(te, uf, pf, k=K)
    return rounded(j.select(*KEYS, "user", F.col("uf")[0].alias("uf0"), F.col("pf")[0].alias("pf0")))


@register("lookup_factors", W(SQL_T0 + SQL_INIT_TR,
                              f"SELECT {SQL_KEYS}, x.{QU}, {r6(f'CASE WHEN u.id IS NULL OR p.id IS NULL THEN NULL ELSE {DOT_UP} END', 'score')} "
                              f"FROM te x LEFT JOIN u0 u ON x.{QU} = u.id LEFT JOIN p0 p ON x.product = p.id"))
def q_lookup_factors(spark, sf):
    tr, te = _first_block(spark, sf)
    uf, pf = _init_from(tr)
    j = FA.lookup_factors(te, uf, pf, k=K)
    return rounded(j.select(*KEYS, "user", V.dot("uf", "pf", K).alias("score")))


def _gd1_sql():
    ctes, ut, pt = O.batch_gd_ctes("tr", K, 1, GAMMA, LAMBDA)
    return ctes


@register("warm_start", W(SQL_T0 + _gd1_sql() + SQL_INIT_ALL,
                          f"SELECT id, {fcols()} FROM (SELECT * FROM u1 UNION ALL "
                          f"SELECT a.* FROM ua a LEFT JOIN u1 b ON a.id = b.id WHERE b.id IS NULL)"))
def q_warm_start(spark, sf):
    tr, _ = _first_block(spark, sf)
    uf1, _ = batch_gd(tr, K, 1, GAMMA, LAMBDA)
    ws = FA.warm_start(uf1, _ratings(spark, sf), "user", K, "user")
    return rounded(_factor_out(ws))


@register("factors_upsert", W(SQL_T0 + _gd1_sql() + SQL_INIT_ALL,
                              f"SELECT id, {fcols()} FROM (SELECT * FROM p1 UNION ALL "
                              f"SELECT a.* FROM pa a LEFT JOIN p1 b ON a.id = b.id WHERE b.id IS NULL)"))
def q_factors_upsert(spark, sf):
    """Vectors of all products, then those that time block 0 changed."""
    r = _ratings(spark, sf)
    tr, _ = _first_block(spark, sf)
    _, pf1 = batch_gd(tr, K, 1, GAMMA, LAMBDA)
    store = factor_store(spark, SK.scratch_path(spark, "factors"), "product")
    store.write(0, FA.init_factors(r, "product", K, "product"))
    store.write(1, pf1)
    return rounded(_factor_out(store.read(1)))


# ------------------------------------------------------------ projections / filters

@register("project_pairs", W(SQL_R, f"SELECT {QU}, product FROM r"))
def q_project_pairs(spark, sf):
    return _ratings(spark, sf).select("user", "product")


@register("project_keyed", W(SQL_R, f"SELECT {QU}, product, count(*) AS n, {r6('sum(rating)', 'total')} "
                                   f"FROM r GROUP BY {QU}, product"))
def q_project_keyed(spark, sf):
    """Rows under a (user, product) struct as their key, added up by it."""
    keyed = _ratings(spark, sf).select(F.struct("user", "product").alias("key"), "rating")
    return rounded(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))
                   .select("key.user", "key.product", "n", "total"))


@register("feedback_to_rating", W(SQL_FB, "SELECT seq, code, rating FROM fb"))
def q_feedback_to_rating(spark, sf):
    return S.feedback(spark, sf).select("seq", "code", "rating")


SQL_PRED_INIT = f"pr AS ({O.predict_select('te', 'u0', 'p0', K)})"


@register("prediction_rows", W(SQL_RS + SQL_INIT_TR + [SQL_PRED_INIT],
                               f"SELECT {QU}, product, {r6('prediction', 'prediction')}, 0 AS timestamp FROM pr"))
def q_prediction_rows(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    p = RC.predict(te.select("user", "product"), uf, pf, K)
    return rounded(p.select("user", "product", "prediction", F.lit(0).alias("timestamp")))


@register("positives", W(SQL_FB, f"SELECT seq, {QU}, product FROM fb WHERE rating > 0.9e0"))
def q_positives(spark, sf):
    return H.positives(S.feedback(spark, sf)).select("seq", "user", "product")


@register("same_user_history", W(SQL_FB,
    f"SELECT a.seq, a.{QU}, (SELECT count(*) FROM fi b WHERE b.{QU} = a.{QU} AND b.idx < a.idx) AS n_before, "
    f"(SELECT count(*) FROM fi b WHERE b.{QU} = a.{QU} AND b.idx >= a.idx) AS n_from FROM fi a"))
def q_same_user_history(spark, sf):
    h = H.history_counts(_feedback_indexed(spark, sf))
    return h.select("seq", "user", "n_before", "n_from")


@register("past_products", W(SQL_FB,
    f"SELECT a.seq, a.{QU}, a.product, (SELECT count(DISTINCT b.product) FROM fi b "
    f"WHERE b.{QU} = a.{QU} AND b.idx < a.idx) AS n_past FROM fi a"))
def q_past_products(spark, sf):
    h = H.history_counts(_feedback_indexed(spark, sf))
    return h.select("seq", "user", "product", "n_past")


@register("future_positives", W(SQL_FB,
    f"SELECT a.seq, a.{QU}, a.product, (SELECT count(DISTINCT b.product) FROM fi b "
    f"WHERE b.{QU} = a.{QU} AND b.idx >= a.idx AND b.rating > 0.9e0) AS n_future FROM fi a"))
def q_future_positives(spark, sf):
    h = H.history_counts(_feedback_indexed(spark, sf))
    return h.select("seq", "user", "product", "n_future")


# ------------------------------------------------------------ ordering

@register("global_index", W(SQL_R + SQL_IX[:1], f"SELECT okey, line, product, supp, {QU}, idx FROM ix"))
def q_global_index(spark, sf):
    ix = OR.global_index(_ratings(spark, sf), S.RATINGS_ORDER)
    return ix.select(*KEYS, "user", "idx")


@register("time_blocks", W(SQL_R + SQL_IX, "SELECT okey, line, product, supp, idx, block FROM ib"))
def q_time_blocks(spark, sf):
    r = _ratings(spark, sf)
    ix = OR.global_index(r, S.RATINGS_ORDER)
    n = ix.count()
    return OR.time_blocks(ix, n).select(*KEYS, "idx", "block")


@register("slice_rows", W(SQL_R + SQL_IX,
    "SELECT okey, line, product, supp, idx FROM ix WHERE idx >= (SELECT lo FROM ed WHERE block = 10) "
    "AND idx < (SELECT lo FROM ed WHERE block = 12)"))
def q_slice_rows(spark, sf):
    ix = OR.global_index(_ratings(spark, sf), S.RATINGS_ORDER)
    n = ix.count()
    lo, hi = math.floor(n / 50.0 * 10), math.floor(n / 50.0 * 12)
    return OR.slice_rows(ix, lo, hi).select(*KEYS, "idx")


@register("holdout_split", W(SQL_RS, "SELECT okey, line, product, supp, is_train FROM s"))
def q_holdout_split(spark, sf):
    return _split(spark, sf).select(*KEYS, "is_train")


@register("rebalance_cache", W(SQL_R, f"SELECT {QU}, product, rating FROM r"))
def q_rebalance_cache(spark, sf):
    r = OR.rebalance(_ratings(spark, sf).select("user", "product", "rating"))
    return r.persist(StorageLevel.MEMORY_AND_DISK)


SQL_BUF = SQL_FB + [
    f"fo AS (SELECT *, row_number() OVER (PARTITION BY {QU} ORDER BY idx) AS uord FROM fi)",
    f"buf AS (SELECT a.idx, CAST(a.uord - b.uord AS BIGINT) AS pos, b.idx AS b_idx, "
    f"CAST(b.product AS BIGINT) AS b_product, b.rating AS b_rating FROM fo a JOIN fo b "
    f"ON a.{QU} = b.{QU} AND b.uord <= a.uord AND b.uord > a.uord - {LAST_K})",
]


@register("last_k_buffer", W(SQL_BUF, "SELECT * FROM buf"))
def q_last_k_buffer(spark, sf):
    b = H.last_k_buffer(_feedback_indexed(spark, sf), LAST_K)
    return b.select("idx", F.col("pos").cast("long").alias("pos"), "b_idx", "b_product", "b_rating")


@register("replay_sequence", W(SQL_BUF + ["bl AS (SELECT *, count(*) OVER (PARTITION BY idx) AS len FROM buf)"],
    f"SELECT idx, CAST(p.range * len + pos AS BIGINT) AS step, CAST(p.range AS BIGINT) AS pass, b_product "
    f"FROM bl, range(0, {config.REPLAY_PASSES}) p"))
def q_replay_sequence(spark, sf):
    b = H.last_k_buffer(_feedback_indexed(spark, sf), LAST_K)
    rp = H.replay_sequence(b)
    return rp.select("idx", "step", F.col("pass").cast("long").alias("pass"), "b_product")


@register("distinct_products", W(SQL_FB,
    f"SELECT {QU}, product, min(idx) AS first_idx, row_number() OVER (PARTITION BY {QU} ORDER BY min(idx)) AS pos "
    f"FROM fi GROUP BY {QU}, product"))
def q_distinct_products(spark, sf):
    return H.distinct_products(_feedback_indexed(spark, sf))


# ------------------------------------------------------------ ranking on fixed (init) factors

def _fb_factors(spark, sf):
    fb = S.feedback(spark, sf)
    return _init_from(fb, implicit=True)


def _users(uf):
    return uf.select(F.col("id").alias("user"), F.col("f").alias("uf"))


@register("score_catalogue", W(SQL_FB + SQL_FB_INIT, f"SELECT {QU}, product, {r6('score', 'score')} FROM sc"))
def q_score_catalogue(spark, sf):
    uf, pf = _fb_factors(spark, sf)
    return rounded(RC.score_catalogue(_users(uf), pf, K))


SQL_TOP = (f"SELECT {QU}, product, rank FROM (SELECT *, row_number() OVER (PARTITION BY {QU} "
           f"ORDER BY score DESC, product) AS rank FROM {{src}}) WHERE rank <= {TOP_R}")


@register("topk_recommend", W(SQL_FB + SQL_FB_INIT, SQL_TOP.format(src="sc")))
def q_topk_recommend(spark, sf):
    uf, pf = _fb_factors(spark, sf)
    return RC.recommend_top_r(uf, pf, K, TOP_R).select("user", "product", "rank")


@register("recommend_top_r", W(SQL_FB + SQL_FB_INIT + [
    f"seen AS (SELECT DISTINCT {QU}, product FROM fb)",
    f"cand AS (SELECT sc.* FROM sc LEFT JOIN seen s ON sc.{QU} = s.{QU} AND sc.product = s.product WHERE s.product IS NULL)"],
    SQL_TOP.format(src="cand")))
def q_recommend_top_r(spark, sf):
    fb = S.feedback(spark, sf)
    uf, pf = _init_from(fb, implicit=True)
    return RC.recommend_top_r(uf, pf, K, TOP_R, seen=fb).select("user", "product", "rank")


@register("exclude_past", W(SQL_FB + SQL_FB_INIT + [f"seen AS (SELECT DISTINCT {QU}, product FROM fb)"],
    f"SELECT sc.{QU}, sc.product, {r6('sc.score', 'score')} FROM sc LEFT JOIN seen s "
    f"ON sc.{QU} = s.{QU} AND sc.product = s.product WHERE s.product IS NULL"))
def q_exclude_past(spark, sf):
    fb = S.feedback(spark, sf)
    uf, pf = _init_from(fb, implicit=True)
    return rounded(RC.score_catalogue(_users(uf), pf, K, seen=fb))


# the stream is cut at edge(25) of 50 blocks: past = before, future = positives after
SQL_HALF = SQL_FB + SQL_FB_INIT + [
    f"cut AS (SELECT CAST(floor(count(*) / {O.dbl(config.N_BLOCKS)} * 25) AS BIGINT) AS m FROM fb)",
    f"past AS (SELECT DISTINCT {QU}, CAST(product AS BIGINT) AS product FROM fi, cut WHERE idx < m)",
    f"fut AS (SELECT DISTINCT {QU}, CAST(product AS BIGINT) AS product FROM fi, cut WHERE idx >= m AND rating > 0.9e0)",
    f"cand AS (SELECT sc.* FROM sc LEFT JOIN past s ON sc.{QU} = s.{QU} AND sc.product = s.product WHERE s.product IS NULL)",
    f"rec AS ({SQL_TOP.format(src='cand')})",
    f"hit AS (SELECT rec.* FROM rec WHERE EXISTS (SELECT 1 FROM fut f WHERE f.{QU} = rec.{QU} AND f.product = rec.product))",
]


def _half(spark, sf):
    fi = _feedback_indexed(spark, sf)
    n = fi.count()
    m = math.floor(n / float(config.N_BLOCKS) * 25)
    past = fi.where(F.col("idx") < m).select("user", F.col("product").cast("long").alias("product"))
    fut = H.positives(fi.where(F.col("idx") >= m)).select("user", F.col("product").cast("long").alias("product"))
    return fi, past.distinct(), fut.distinct()


@register("past_anti", W(SQL_HALF, f"SELECT {QU}, product, {r6('score', 'score')} FROM cand"))
def q_past_anti(spark, sf):
    _, past, _ = _half(spark, sf)
    uf, pf = _fb_factors(spark, sf)
    return rounded(RC.score_catalogue(_users(uf), pf, K, seen=past))


@register("hits_semi", W(SQL_HALF, "SELECT * FROM hit"))
def q_hits_semi(spark, sf):
    _, past, fut = _half(spark, sf)
    uf, pf = _fb_factors(spark, sf)
    rec = RC.recommend_top_r(uf, pf, K, TOP_R, seen=past)
    return H.hits_semi(rec, fut).select("user", "product", "rank")


@register("recall_value", W(SQL_HALF,
    f"SELECT f.{QU}, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits, f.n_future, "
    f"{r6('coalesce(h.hits, 0) / f.n_future', 'recall')} FROM "
    f"(SELECT {QU}, count(*) AS n_future FROM fut GROUP BY {QU}) f LEFT JOIN "
    f"(SELECT {QU}, count(*) AS hits FROM hit GROUP BY {QU}) h ON f.{QU} = h.{QU}"))
def q_recall_value(spark, sf):
    _, past, fut = _half(spark, sf)
    uf, pf = _fb_factors(spark, sf)
    rec = RC.recommend_top_r(uf, pf, K, TOP_R, seen=past)
    hits = H.hits_semi(rec, fut).groupBy("user").agg(F.count(F.lit(1)).alias("hits"))
    nf = fut.groupBy("user").agg(F.count(F.lit(1)).alias("n_future"))
    out = nf.join(hits, "user", "left").fillna(0, ["hits"])
    return rounded(out.select("user", "hits", "n_future", V.recall_value("hits", "n_future").alias("recall")))


@register("set_membership", W(SQL_HALF + [
    f"us AS (SELECT {QU} FROM past UNION SELECT {QU} FROM fut)",
    f"bo AS (SELECT {QU}, product FROM past INTERSECT SELECT {QU}, product FROM fut)",
    f"nw AS (SELECT {QU}, product FROM fut EXCEPT SELECT {QU}, product FROM past)"],
    f"SELECT us.{QU}, "
    f"(SELECT count(*) FROM past x WHERE x.{QU} = us.{QU}) AS n_past, "
    f"(SELECT count(*) FROM fut x WHERE x.{QU} = us.{QU}) AS n_future, "
    f"(SELECT count(*) FROM bo x WHERE x.{QU} = us.{QU}) AS n_both, "
    f"(SELECT count(*) FROM nw x WHERE x.{QU} = us.{QU}) AS n_new FROM us"))
def q_set_membership(spark, sf):
    _, past, fut = _half(spark, sf)
    return H.set_membership(past, fut)


# ------------------------------------------------------------ recall at every event

SQL_E8 = SQL_FB + SQL_FB_INIT + [
    f"fl AS (SELECT {QU}, product, min(idx) AS first_idx, max(CASE WHEN rating > 0.9e0 THEN idx END) AS last_pos "
    f"FROM fi GROUP BY {QU}, product)",
    f"cand AS (SELECT e.idx, e.{QU}, s.product, s.score FROM fi e JOIN sc s ON s.{QU} = e.{QU} "
    f"LEFT JOIN fl ON fl.{QU} = e.{QU} AND fl.product = s.product WHERE fl.first_idx IS NULL OR fl.first_idx >= e.idx)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, product) AS rn FROM cand)",
    f"hits AS (SELECT rk.idx, count(*) AS hits FROM rk JOIN fl ON fl.{QU} = rk.{QU} AND fl.product = rk.product "
    f"WHERE rk.rn <= {TOP_R} AND fl.last_pos >= rk.idx GROUP BY rk.idx)",
    f"nf AS (SELECT e.idx, count(fl.product) AS n_future FROM fi e LEFT JOIN fl ON fl.{QU} = e.{QU} "
    "AND fl.last_pos >= e.idx GROUP BY e.idx)",
    f"e8 AS (SELECT e.idx, e.{QU}, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits, nf.n_future, "
    "CASE WHEN nf.n_future = 0 THEN NULL ELSE coalesce(h.hits, 0) / nf.n_future END AS recall "
    "FROM fi e JOIN nf ON nf.idx = e.idx LEFT JOIN hits h ON h.idx = e.idx)",
]


def _e8(spark, sf):
    fi = _feedback_indexed(spark, sf)
    uf, pf = _init_from(fi, implicit=True)
    return recall_at_events(fi, uf, pf, K, TOP_R)


@register("eval_recall_frozen", W(SQL_E8, f"SELECT idx, {QU}, hits, n_future, {r6('recall', 'recall')} FROM e8"))
def q_eval_recall_frozen(spark, sf):
    return rounded(_e8(spark, sf))


@register("drop_not_applicable", W(SQL_E8, f"SELECT idx, {r6('recall', 'recall')} FROM e8 WHERE recall IS NOT NULL"))
def q_drop_not_applicable(spark, sf):
    return rounded(H.drop_not_applicable(_e8(spark, sf)).select("idx", "recall"))


@register("mean_recall", W(SQL_E8, f"SELECT count(*) AS n, {r6('avg(recall)', 'recall')} FROM e8 WHERE recall IS NOT NULL"))
def q_mean_recall(spark, sf):
    return rounded(M.mean_recall(_e8(spark, sf)))


@register("round_recall", W(SQL_E8 + [
    "kp AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS k FROM e8 WHERE recall IS NOT NULL)"],
    f"SELECT k // {RECALL_ROUND} + 1 AS round, count(*) AS n, {r6('avg(recall)', 'recall')} FROM kp "
    f"GROUP BY k // {RECALL_ROUND} HAVING count(*) = {RECALL_ROUND}"))
def q_round_recall(spark, sf):
    kept = H.drop_not_applicable(_e8(spark, sf))
    kept = OR.global_index(kept, ["idx"], idx="k")
    return rounded(M.round_metric(kept, "k", RECALL_ROUND, F.avg("recall"), "recall"))


# ------------------------------------------------------------ vectors / predictions

SQL_ALLPAIRS = SQL_RS + SQL_INIT_ALL


@register("init_factor_5", W(SQL_R + SQL_INIT_ALL, f"SELECT id, {fcols()} FROM ua"))
def q_init_factor_5(spark, sf):
    uf, _ = _init_from(_ratings(spark, sf))
    return rounded(_factor_out(uf))


@register("init_factor_1", W(SQL_FB + SQL_FB_INIT, f"SELECT id, {fcols()} FROM pi"))
def q_init_factor_1(spark, sf):
    _, pf = _fb_factors(spark, sf)
    return rounded(_factor_out(pf))


def _all_pairs(spark, sf):
    """Every rating with both its vectors."""
    r = _ratings(spark, sf)
    uf, pf = _init_from(r)
    return FA.lookup_factors(r, uf, pf, k=K)


SQL_JOIN_ALL = "FROM r x JOIN ua u ON x.\"user\" = u.id JOIN pa p ON x.product = p.id"


@register("dot_product", W(SQL_ALLPAIRS, f"SELECT {SQL_KEYS}, {r6(DOT_UP, 'dot')} {SQL_JOIN_ALL}"))
def q_dot_product(spark, sf):
    return rounded(_all_pairs(spark, sf).select(*KEYS, V.dot("uf", "pf", K).alias("dot")))


@register("axpy", W(SQL_ALLPAIRS, f"SELECT {SQL_KEYS}, " +
                    ", ".join(r6(f"u.f{j} + 0.5e0 * p.f{j}", f"v{j}") for j in range(K)) + f" {SQL_JOIN_ALL}"))
def q_axpy(spark, sf):
    j = _all_pairs(spark, sf).select(*KEYS, V.axpy(0.5, "pf", "uf", K).alias("v"))
    return rounded(j.select(*KEYS, *V.unpack("v", K, "v")))


@register("prediction_error", W(SQL_ALLPAIRS, f"SELECT {SQL_KEYS}, {r6(f'x.rating - ({DOT_UP})', 'e')} {SQL_JOIN_ALL}"))
def q_prediction_error(spark, sf):
    j = _all_pairs(spark, sf)
    return rounded(j.select(*KEYS, V.prediction_error("rating", "uf", "pf", K).alias("e")))


@register("cold_start", W(SQL_T0 + SQL_INIT_TR + [f"pr AS ({O.predict_select('te', 'u0', 'p0', K)})"],
    f"SELECT okey, line, product, supp, {r6('prediction', 'prediction')}, is_cold FROM pr"))
def q_cold_start(spark, sf):
    tr, te = _first_block(spark, sf)
    uf, pf = _init_from(tr)
    return rounded(RC.predict(te, uf, pf, K).select(*KEYS, "prediction", "is_cold"))


@register("squared_error", W(SQL_RS + SQL_INIT_TR + [SQL_PRED_INIT],
    f"SELECT okey, line, product, supp, {r6('(rating - prediction) * (rating - prediction)', 'se')} FROM pr"))
def q_squared_error(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    p = RC.predict(te, uf, pf, K)
    return rounded(p.select(*KEYS, V.squared_error("rating", "prediction").alias("se")))


# ------------------------------------------------------------ joins / aggregates

@register("join_actual_predicted", W(SQL_RS + SQL_INIT_TR + [SQL_PRED_INIT],
    f"SELECT t.{QU}, t.product, t.rating, {r6('p.prediction', 'prediction')} FROM te t JOIN pr p "
    f"ON t.{QU} = p.{QU} AND t.product = p.product"))
def q_join_actual_predicted(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    pred = RC.predict(te.select("user", "product"), uf, pf, K)
    j = te.select("user", "product", "rating").join(pred, ["user", "product"])
    return rounded(j.select("user", "product", "rating", "prediction"))


@register("sum_count_treereduce", W(SQL_RS + SQL_INIT_TR + [SQL_PRED_INIT],
    f"SELECT count(*) AS n, {r6('sum((t.rating - p.prediction) * (t.rating - p.prediction))', 'total')} "
    f"FROM te t JOIN pr p ON t.{QU} = p.{QU} AND t.product = p.product"))
def q_sum_count_treereduce(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    pred = RC.predict(te.select("user", "product"), uf, pf, K)
    j = te.select("user", "product", "rating").join(pred, ["user", "product"])
    return rounded(M.sum_count(j.select(V.squared_error("rating", "prediction").alias("se")), "se"))


@register("rmse", W(SQL_RS + SQL_INIT_TR + [SQL_PRED_INIT],
    f"SELECT count(*) AS n, {r6('sum((rating - prediction) * (rating - prediction))', 'sse')}, "
    f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')}, "
    "sum(CAST(is_cold AS BIGINT)) AS unknown FROM pr"))
def q_rmse(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    return rounded(M.rmse(RC.predict(te, uf, pf, K)))


@register("unknown_count", W(SQL_T0 + SQL_INIT_TR + [SQL_PRED_INIT],
    "SELECT count(*) AS n, sum(CAST(is_cold AS BIGINT)) AS unknown FROM pr"))
def q_unknown_count(spark, sf):
    tr, te = _first_block(spark, sf)
    uf, pf = _init_from(tr)
    return M.unknown_count(RC.predict(te, uf, pf, K))


@register("round_rmse", W(SQL_RS + SQL_INIT_TR + [
    "ix AS (SELECT *, CAST(row_number() OVER (ORDER BY ts, okey, line, product, supp) - 1 AS BIGINT) AS idx FROM r)",
    f"pr AS ({O.predict_select('ix', 'u0', 'p0', K)})"],
    f"SELECT idx // {ROUND_ROWS} + 1 AS round, count(*) AS n, "
    f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')} FROM pr "
    f"GROUP BY idx // {ROUND_ROWS} HAVING count(*) = {ROUND_ROWS}"))
def q_round_rmse(spark, sf):
    r = _ratings(spark, sf)
    tr, _ = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    ix = OR.global_index(r, S.RATINGS_ORDER)
    return rounded(M.round_rmse(RC.predict(ix, uf, pf, K), "idx", ROUND_ROWS))


@register("gradient_aggregate", W(SQL_RS + _gd1_sql(),
    f"SELECT {QU}, count(*) AS n, " + ", ".join(r6(f"avg(e * pf{j})", f"g{j}") for j in range(K)) +
    f" FROM j1 GROUP BY {QU}"))
def q_gradient_aggregate(spark, sf):
    tr, _ = _train_test(spark, sf)
    uf, pf = _init_from(tr)
    j = FA.lookup_factors(tr.select("user", "product", "rating"), uf, pf, k=K)
    j = j.withColumn("e", V.prediction_error("rating", "uf", "pf", K))
    g = M.gradient_aggregate(j, "user", [F.col("e") * F.col("pf")[i] for i in range(K)])
    return rounded(g)


def _holdout_sql():
    return O.eval_holdout(K, EPOCHS, GAMMA, LAMBDA)


# ------------------------------------------------------------ metrics log (SNK2)

NO = {c: f"CAST(NULL AS {t}) AS {c}" for c, t in (
    ("round", "BIGINT"), ("lo", "BIGINT"), ("hi", "BIGINT"), ("unknown", "BIGINT"),
    ("rmse", "DOUBLE"), ("recall", "DOUBLE"))}


def _log_select(protocol: str, source: str, **has: str) -> str:
    cols = ", ".join(f"{has[c]} AS {c}" if c in has else NO[c] for c in NO)
    return f"SELECT 'r1' AS run, '{protocol}' AS protocol, {has['n']} AS n, {cols} FROM ({source})"


@register("metrics_log", " UNION ALL ".join([
    _log_select("holdout", _holdout_sql(), n="n", unknown="unknown", rmse="rmse"),
    _log_select("first block", W(SQL_T0 + SQL_INIT_TR + [SQL_PRED_INIT],
                                 "SELECT count(*) AS n, sum(CAST(is_cold AS BIGINT)) AS unknown, "
                                 f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')} FROM pr"),
                n="n", unknown="unknown", rmse="rmse"),
    _log_select("rounds", ORACLE["round_rmse"], n="n", round="round", rmse="rmse"),
    _log_select("recall", ORACLE["mean_recall"], n="n", recall="recall"),
    _log_select("recall", ORACLE["round_recall"], n="n", round="round", recall="recall")]))
def q_metrics_log(spark, sf):
    """Overall rows and rounds of several protocols in one log; every protocol
    is evaluated once and its metrics are written three times: twice for the
    run, as by a rerun, and once for another run."""
    path = SK.scratch_path(spark, "metrics")
    first, every = _first_block(spark, sf)
    with SK.Timed() as cost:
        holdout = materialize(P.eval_holdout(_ratings(spark, sf), S.RATINGS_HASH_KEY, K, EPOCHS, GAMMA, LAMBDA))
    e8 = materialize(_e8(spark, sf))
    logged = {
        "holdout": (holdout, cost.ms),
        "first block": (materialize(M.rmse(RC.predict(every, *_init_from(first), K))), None),
        "rounds": (materialize(q_round_rmse(spark, sf)), None),
        "recall": (materialize(P.recall_metrics(e8, RECALL_ROUND)), None),
    }
    for run in ("r0", "r1", "r1"):
        for protocol, (rows, ms) in logged.items():
            SK.write_metrics(rows, path, run, protocol, ms)
    m = SK.read_metrics(spark, path).where(F.col("run") == "r1")
    return rounded(m.select("run", "protocol", "n", *NO))


# ------------------------------------------------------------ learning + protocols

def _gd2_sql():
    ctes, _, _ = O.batch_gd_ctes("tr", K, EPOCHS, GAMMA, LAMBDA)
    return ctes


@register("mf_batch_gd", W(SQL_RS + _gd2_sql(),
    f"SELECT 'user' AS side, id, {fcols()} FROM u{EPOCHS} UNION ALL "
    f"SELECT 'product' AS side, id, {fcols()} FROM p{EPOCHS}"))
def q_mf_batch_gd(spark, sf):
    tr, _ = _train_test(spark, sf)
    uf, pf = batch_gd(tr, K, EPOCHS, GAMMA, LAMBDA)
    return rounded(_factor_out(uf, "user").unionByName(_factor_out(pf, "product")))


@register("predict_batch", W(SQL_RS + _gd2_sql() + [f"pr AS ({O.predict_select('te', f'u{EPOCHS}', f'p{EPOCHS}', K)})"],
    f"SELECT okey, line, product, supp, {r6('prediction', 'prediction')}, is_cold FROM pr"))
def q_predict_batch(spark, sf):
    tr, te = _train_test(spark, sf)
    uf, pf = batch_gd(tr, K, EPOCHS, GAMMA, LAMBDA)
    return rounded(RC.predict(te, uf, pf, K).select(*KEYS, "prediction", "is_cold"))


@register("eval_holdout", _holdout_sql())
def q_eval_holdout(spark, sf):
    return rounded(P.eval_holdout(_ratings(spark, sf), S.RATINGS_HASH_KEY, K, EPOCHS, GAMMA, LAMBDA))


def _expanding_sql():
    ctes = SQL_R + SQL_IX + [
        f"trx AS (SELECT b.range AS round, ib.{QU}, ib.product, ib.rating FROM ib "
        f"JOIN range(1, {config.N_BLOCKS}) b ON ib.block < b.range)",
        f"tex AS (SELECT block AS round, {QU}, product, rating FROM ib WHERE block >= 1)",
    ]
    gd, ut, pt = O.batch_gd_ctes("trx", K, EPOCHS, GAMMA, LAMBDA, keys=["round"])
    ctes += gd
    ctes.append(
        f"pr AS (SELECT x.*, CASE WHEN u.id IS NULL OR p.id IS NULL THEN {O.dbl(config.COLD_START)} "
        f"ELSE {DOT_UP} END AS prediction, (u.id IS NULL OR p.id IS NULL) AS is_cold FROM tex x "
        f"LEFT JOIN {ut} u ON x.round = u.round AND x.{QU} = u.id "
        f"LEFT JOIN {pt} p ON x.round = p.round AND x.product = p.id)")
    return W(ctes,
             "SELECT ed.block AS round, ed.lo, ed.hi, count(pr.rating) AS n, "
             "coalesce(sum(CAST(is_cold AS BIGINT)), 0) AS unknown, "
             f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')} "
             "FROM ed LEFT JOIN pr ON ed.block = pr.round WHERE ed.block >= 1 "
             "GROUP BY ed.block, ed.lo, ed.hi")


@register("eval_expanding", _expanding_sql())
def q_eval_expanding(spark, sf):
    return rounded(P.eval_expanding(_ratings(spark, sf), S.RATINGS_ORDER, K, EPOCHS, GAMMA, LAMBDA))


# ------------------------------------------------------------ learning (no SQL oracle: iterative / sequential)

SGD_RATE = 0.01
BLOCKS = config.GRID


@register("shuffle_epoch", W(SQL_R, "SELECT okey, line, product, supp, CAST(e.range AS BIGINT) AS epoch, "
                                   f"{O.row_hash(['e.range', 'okey', 'line', 'product', 'supp'])} AS key "
                                   "FROM r, range(0, 2) e"))
def q_shuffle_epoch(spark, sf):
    """Per-epoch pseudo-random visiting order (seeded, layout independent)."""
    r = _ratings(spark, sf)
    e = r.select(*KEYS, F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    return e.select(*KEYS, "epoch", OR.shuffle_key(KEYS, config.SEED, F.col("epoch")).alias("key"))


def _sgd_sql(visits: str, order: str, ctes=(), implicit=False):
    return list(ctes) + [f"vis AS ({visits})"] + O.grid_sgd_ctes(
        "vis", order, K, SGD_RATE, SGD_RATE, LAMBDA, BLOCKS, implicit)


EPOCH_KEY = O.row_hash(["phase"] + KEYS)
SQL_BLOCK_SGD = _sgd_sql(f"SELECT e.range AS phase, NULL::BIGINT AS rid, tr.* FROM tr, range(0, {EPOCHS}) e",
                         f"{EPOCH_KEY}, okey, line, product, supp", SQL_RS)
SQL_PREQ = _sgd_sql(
    f"SELECT CASE WHEN idx < we THEN 0 ELSE 1 + (idx - we) // {config.BATCH_ROWS} END AS phase, "
    "CASE WHEN idx >= we THEN idx END AS rid, ix.*, CASE WHEN idx < we THEN "
    f"{O.row_hash(['0', 'idx'])} ELSE 0 END AS ek FROM ix, wm", "ek, idx",
    SQL_R + SQL_IX + [f"wm AS (SELECT CAST(trunc(n / {O.dbl(config.N_BLOCKS)}) AS BIGINT) AS we FROM nn)"]) + [
    f"fs AS (SELECT min(idx) AS idx FROM ix GROUP BY {QU} "
    "UNION SELECT min(idx) FROM ix GROUP BY product)",
    f"pr AS (SELECT ix.idx, ix.rating, fs.idx IS NOT NULL AS is_cold, CASE WHEN fs.idx IS NOT NULL "
    f"THEN {O.dbl(config.COLD_START)} ELSE st.f[1] END AS prediction FROM ix JOIN st ON st.side = 'r' "
    "AND st.id = ix.idx LEFT JOIN fs ON fs.idx = ix.idx)"]
SQL_SCORED = ("count(*) AS n, sum(CAST(is_cold AS BIGINT)) AS unknown, "
              f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')}")


@register("mf_block_sgd", sequential=W(SQL_BLOCK_SGD, O.factors_from("st", K)))
def q_mf_block_sgd(spark, sf):
    tr, _ = _train_test(spark, sf)
    uf, pf = TR.block_sgd(tr, K, EPOCHS, SGD_RATE, SGD_RATE, LAMBDA, blocks=BLOCKS, order_cols=KEYS)
    return rounded(_factor_out(uf, "user").unionByName(_factor_out(pf, "product")))


@register("mf_distributed_sgd", sequential=W(SQL_BLOCK_SGD, O.factors_from("st", K)))
def q_mf_distributed_sgd(spark, sf):
    tr, _ = _train_test(spark, sf)
    uf, pf = TR.distributed_sgd(tr, K, EPOCHS, SGD_RATE, LAMBDA, blocks=BLOCKS, order_cols=KEYS)
    return rounded(_factor_out(uf, "user").unionByName(_factor_out(pf, "product")))


@register("mf_online_update", sequential=W(_sgd_sql(
    f"SELECT 0 AS phase, NULL::BIGINT AS rid, ix.*, c.range AS c FROM ix, range(0, 2) c", "idx, c",
    SQL_R + SQL_IX), O.factors_from("st", K)))
def q_mf_online_update(spark, sf):
    """L4 on every rating in stream order, from the start vectors."""
    r = OR.global_index(_ratings(spark, sf), S.RATINGS_ORDER)
    uf, pf = _init_from(r)
    uf, pf = TR.online_update(r, uf, pf, K, 2, SGD_RATE, SGD_RATE, LAMBDA, ["idx"])
    return rounded(_factor_out(uf, "user").unionByName(_factor_out(pf, "product")))


@register("mf_last_k_replay", sequential=W(_sgd_sql(
    "SELECT 0 AS phase, NULL::BIGINT AS rid, bl.idx AS event, p.range * len + pos AS step, "
    f"fi.{QU}, b_product AS product, b_rating AS rating FROM bl JOIN fi ON fi.idx = bl.idx, "
    f"range(0, {config.REPLAY_PASSES}) p", "event, step",
    SQL_BUF + ["bl AS (SELECT *, count(*) OVER (PARTITION BY idx) AS len FROM buf)"], implicit=True),
    O.factors_from("st", K)))
def q_mf_last_k_replay(spark, sf):
    fi = _feedback_indexed(spark, sf)
    uf, pf = TR.last_k_replay(fi, K, LAST_K, SGD_RATE, SGD_RATE, LAMBDA, implicit=True)
    return rounded(_factor_out(uf, "user").unionByName(_factor_out(pf, "product")))


SQL_FOLD = SQL_BUF[:-1] + SQL_FB_INIT[:2] + [
    "pl AS (SELECT id, [" + ", ".join(f"f{j}" for j in range(K)) + "] AS pf FROM pi)",
    "fold(id, ord, f) AS (SELECT id, 0::BIGINT, [" + ", ".join(f"f{j}" for j in range(K)) + "] FROM ui "
    "UNION ALL SELECT id, ord, [" + ", ".join(
        f"f[{j}] + {O.dbl(SGD_RATE)} * (e * pf[{j}] - {O.dbl(LAMBDA)} * f[{j}])" for j in range(1, K + 1))
    + "] FROM (SELECT s.id, o.uord AS ord, s.f, p.pf, o.rating - ("
    + " + ".join(f"s.f[{j}] * p.pf[{j}]" for j in range(1, K + 1))
    + f") AS e FROM fold s JOIN fo o ON o.{QU} = s.id AND o.uord = s.ord + 1 JOIN pl p ON p.id = o.product))"]


@register("user_fold_in", W(SQL_FOLD, "SELECT id, " + ", ".join(r6(f"f[{j + 1}]", f"f{j}") for j in range(K))
                            + " FROM fold QUALIFY ord = max(ord) OVER (PARTITION BY id)"))
def q_user_fold_in(spark, sf):
    fi = _feedback_indexed(spark, sf)
    _, pf = _init_from(fi, implicit=True)
    return rounded(_factor_out(TR.user_fold_in(fi, None, pf, K, 1, SGD_RATE, LAMBDA, ["idx"],
                                               implicit=True)))


@register("als_baseline")
def q_als_baseline(spark, sf):
    """Spark ML ALS as an independent quality yardstick (cold rows at 3.5)."""
    from pyspark.ml.recommendation import ALS
    tr, te = _train_test(spark, sf)
    cast = [F.col("user").cast("int").alias("user"), F.col("product").cast("int").alias("product"),
            F.col("rating").cast("float").alias("rating")]
    model = ALS(rank=K, maxIter=5, regParam=0.1, userCol="user", itemCol="product",
                ratingCol="rating", seed=config.SEED % (2 ** 31), coldStartStrategy="nan"
                ).fit(tr.select(*cast))
    pred = model.transform(te.select(*cast))
    pred = pred.withColumn("is_cold", F.isnan("prediction")).withColumn(
        "prediction", F.when(F.isnan("prediction"), F.lit(config.COLD_START))
        .otherwise(F.col("prediction").cast("double")))
    return rounded(M.rmse(pred.withColumn("rating", F.col("rating").cast("double"))))


SQL_SGD_PRED = SQL_BLOCK_SGD + [
    "pr AS (SELECT x.*, u.id IS NULL OR p.id IS NULL AS is_cold, CASE WHEN u.id IS NULL OR p.id IS NULL "
    f"THEN {O.dbl(config.COLD_START)} ELSE " + " + ".join(f"u.f[{j}] * p.f[{j}]" for j in range(1, K + 1))
    + f" END AS prediction FROM te x LEFT JOIN st u ON u.side = 'u' AND u.id = x.{QU} "
    "LEFT JOIN st p ON p.side = 'p' AND p.id = x.product)"]


@register("eval_holdout_sgd", sequential=W(SQL_SGD_PRED,
    "SELECT count(*) AS n, sum(CAST(is_cold AS BIGINT)) AS unknown, "
    f"{r6('sqrt(avg((rating - prediction) * (rating - prediction)))', 'rmse')} FROM pr"))
def q_eval_holdout_sgd(spark, sf):
    """E1 with a step per rating in place of mean gradients."""
    return rounded(P.eval_holdout(_ratings(spark, sf), S.RATINGS_HASH_KEY, K, EPOCHS, SGD_RATE, LAMBDA,
                                  trainer="sgd", blocks=BLOCKS))


@register("eval_expanding_sgd")
def q_eval_expanding_sgd(spark, sf):
    """E3 with a step per rating in place of mean gradients, all 49 rounds."""
    return rounded(P.eval_expanding(_ratings(spark, sf), S.RATINGS_ORDER, K, 1, SGD_RATE, LAMBDA,
                                    trainer="sgd", blocks=BLOCKS))


@register("eval_holdout_distributed", sequential=W(SQL_SGD_PRED,
    f"SELECT count(*) AS n, {r6('sum((t.rating - p.prediction) ** 2)', 'total')}, "
    f"{r6('sqrt(sum((t.rating - p.prediction) ** 2) / count(*))', 'rmse')} FROM te t JOIN pr p "
    f"ON t.{QU} = p.{QU} AND t.product = p.product"))
def q_eval_holdout_distributed(spark, sf):
    return rounded(P.eval_holdout_distributed(_ratings(spark, sf), S.RATINGS_HASH_KEY, K, EPOCHS,
                                              SGD_RATE, LAMBDA, blocks=BLOCKS))


@register("eval_expanding_online")
def q_eval_expanding_online(spark, sf):
    return rounded(P.eval_expanding_online(_ratings(spark, sf), S.RATINGS_ORDER, K, 1, SGD_RATE,
                                           SGD_RATE, LAMBDA))


@register("eval_prequential", sequential=W(SQL_PREQ,
    f"SELECT NULL::BIGINT AS round, {SQL_SCORED} FROM pr UNION ALL "
    f"SELECT (idx - we) // {ROUND_ROWS * 5} + 1, {SQL_SCORED} FROM pr, wm "
    f"GROUP BY 1 HAVING count(*) = {ROUND_ROWS * 5}"))
def q_eval_prequential(spark, sf):
    r = _ratings(spark, sf)
    return rounded(P.eval_prequential(r, S.RATINGS_ORDER, K, 1, SGD_RATE, SGD_RATE, LAMBDA,
                                      round_rows=ROUND_ROWS * 5))


@register("eval_prequential_last_k")
def q_eval_prequential_last_k(spark, sf):
    r = _ratings(spark, sf)
    return rounded(P.eval_prequential_last_k(r, S.RATINGS_ORDER, K, LAST_K, SGD_RATE, SGD_RATE, LAMBDA,
                                             round_rows=ROUND_ROWS * 5))


@register("eval_prequential_recall")
def q_eval_prequential_recall(spark, sf):
    samples = P.eval_prequential_recall(S.feedback(spark, sf), S.FEEDBACK_ORDER, K, 1, SGD_RATE,
                                        SGD_RATE, LAMBDA, r=TOP_R)
    return rounded(P.recall_metrics(samples))


# ------------------------------------------------------------ streaming

from factorcast.streaming import online as ST  # noqa: E402


STREAM_ROWS = 1 << 14      # rows of a micro-batch of the registered streams


def _staged(spark, df, start=0):
    n = df.count()
    bounds = [(lo, min(lo + STREAM_ROWS, n)) for lo in range(start, n, STREAM_ROWS)]
    root = ST.stage_stream(df, "idx", bounds, SK.scratch_path(spark, "stream-src"))
    return ST.read_stream(spark, root, df.schema)


@register("stream_prequential", sequential=W(_sgd_sql(
    f"SELECT CASE WHEN idx < we THEN 0 ELSE 1 + (idx - we) // {STREAM_ROWS} END AS phase, "
    "CASE WHEN idx >= we THEN idx END AS rid, ix.*, CASE WHEN idx < we THEN "
    f"{O.row_hash(['0', 'idx'])} ELSE 0 END AS ek FROM ix, wm", "ek, idx", SQL_PREQ[:len(SQL_R + SQL_IX) + 1])
    + SQL_PREQ[-2:],
    f"SELECT (idx - we) // {STREAM_ROWS} AS batch, min(idx) AS lo, max(idx) + 1 AS hi, {SQL_SCORED} "
    "FROM pr, wm GROUP BY 1"))
def q_stream_prequential(spark, sf):
    ix = OR.global_index(_ratings(spark, sf), S.RATINGS_ORDER).select("idx", "user", "product", "rating")
    n = ix.count()
    warm_end = int(n / float(config.N_BLOCKS))
    uf, pf = TR.block_sgd(ix.where(F.col("idx") < warm_end), K, 1, SGD_RATE, SGD_RATE, LAMBDA,
                          blocks=BLOCKS, order_cols=["idx"])
    return rounded(ST.stream_prequential(_staged(spark, ix, start=warm_end), uf, pf, K, 1, SGD_RATE,
                                         SGD_RATE, LAMBDA))


@register("stream_last_k", ORACLE["last_k_buffer"])
def q_stream_last_k(spark, sf):
    fi = _feedback_indexed(spark, sf).select("idx", "user", "product", "rating")
    out = ST.stream_last_k(_staged(spark, fi), LAST_K)
    return out.select("idx", "pos", "b_idx", "b_product", "b_rating")


@register("stream_recommend")
def q_stream_recommend(spark, sf):
    fi = _feedback_indexed(spark, sf).select("idx", "user", "product", "rating")
    return ST.stream_recommend(_staged(spark, fi), K, 1, SGD_RATE, SGD_RATE, LAMBDA, TOP_R)


# ------------------------------------------------------------ recommendation log (SNK3)

from factorcast.operators.recall import future_at_events, recommendations_at_events  # noqa: E402


@register("recommendation_log", W(SQL_E8 + [
    f"rl AS (SELECT idx, string_agg(CAST(product AS VARCHAR), ',' ORDER BY rn) AS recommended "
    f"FROM rk WHERE rn <= {TOP_R} GROUP BY idx)",
    f"fu AS (SELECT e.idx, string_agg(CAST(fl.product AS VARCHAR), ',' ORDER BY fl.product) AS future "
    f"FROM fi e JOIN fl ON fl.{QU} = e.{QU} AND fl.last_pos >= e.idx GROUP BY e.idx)"],
    "SELECT fu.idx, rl.recommended, fu.future FROM fu LEFT JOIN rl ON rl.idx = fu.idx"))
def q_recommendation_log(spark, sf):
    fi = _feedback_indexed(spark, sf)
    uf, pf = _init_from(fi, implicit=True)
    recs = recommendations_at_events(fi, uf, pf, K, TOP_R)
    fut = future_at_events(fi)
    log = SK.recommendation_log(recs, fut).where(F.col("future").isNotNull())
    return log.select("idx", F.array_join("recommended", ",").alias("recommended"),
                      F.array_join("future", ",").alias("future"))
