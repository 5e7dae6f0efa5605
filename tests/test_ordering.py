"""Global index, blocks and the skew-safe two-level running counts."""

import math

from pyspark.sql import functions as F

from factorcast.operators import history as H
from factorcast.operators import ordering as OR
from factorcast.sources import tables as S
import pytest
from paths import SF001


def test_global_index_dense_and_ordered(spark):
    r = S.ratings(spark, SF001)
    ix = OR.global_index(r, S.RATINGS_ORDER, num_partitions=5).toPandas()
    assert sorted(ix["idx"]) == list(range(len(ix)))
    ix = ix.sort_values("idx")
    keys = list(zip(*(ix[c] for c in S.RATINGS_ORDER)))
    assert keys == sorted(keys)


def test_block_edge_drops_last_row_n29(spark):
    n = 29
    df = spark.range(n).select(F.col("id").alias("idx"))
    b = OR.time_blocks(df, n).toPandas().sort_values("idx")
    edges = [math.floor(n / 50.0 * i) for i in range(51)]
    assert edges[50] == 28
    assert b["block"].isna().sum() == 1 and math.isnan(b["block"].iloc[-1])
    for i, blk in zip(b["idx"], b["block"]):
        if not math.isnan(blk):
            assert edges[int(blk)] <= i < edges[int(blk) + 1]


def test_blocks_partition_rows(spark):
    for n in (7, 50, 57, 58, 1000):
        df = spark.range(n).select(F.col("id").alias("idx"))
        b = OR.time_blocks(df, n).toPandas()
        edges = [math.floor(n / 50.0 * i) for i in range(51)]
        want = [next((k for k in range(50) if edges[k] <= i < edges[k + 1]), None) for i in range(n)]
        got = [None if (v != v) else int(v) for v in b.sort_values("idx")["block"]]
        assert got == want


def test_count_before_chunked_equals_plain(spark):
    fi = OR.global_index(S.feedback(spark, SF001), S.FEEDBACK_ORDER)
    a = H.history_counts(fi, chunk_rows=1 << 20).select("seq", "n_past", "n_future", "n_before", "n_from")
    b = H.history_counts(fi, chunk_rows=7).select("seq", "n_past", "n_future", "n_before", "n_from")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_last_k_zero_and_one(spark):
    fi = OR.global_index(S.feedback(spark, SF001), S.FEEDBACK_ORDER)
    assert H.last_k_buffer(fi, 0).count() == 0
    one = H.last_k_buffer(fi, 1).toPandas()
    assert len(one) == fi.count() and (one["idx"] == one["b_idx"]).all()


def test_split_layout_independent(spark):
    r = S.ratings(spark, SF001)
    a = OR.holdout_split(r.repartition(3), S.RATINGS_HASH_KEY).select(*S.RATINGS_HASH_KEY, "is_train")
    b = OR.holdout_split(r.repartition(11), S.RATINGS_HASH_KEY).select(*S.RATINGS_HASH_KEY, "is_train")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    frac = a.where("is_train").count() / a.count()
    assert 0.75 < frac < 0.85


def test_upsert_keeps_unchanged_ids(spark):
    from factorcast.sources.factors import init_factors, upsert
    r = S.ratings(spark, SF001)
    old = init_factors(r, "product", 4, "product")
    changed = old.limit(0).unionByName(
        old.where("id % 2 = 0").select("id", F.transform("f", lambda x: x * 2).alias("f")))
    got = {row.id: row.f for row in upsert(old, changed).collect()}
    want = {row.id: row.f for row in old.collect()}
    assert set(got) == set(want)
    for i, f in want.items():
        assert got[i] == ([x * 2 for x in f] if i % 2 == 0 else f)


@pytest.mark.parametrize("k,halo", [(0, 4), (1, 4), (3, 4), (3, 1), (5, 2), (4, 4096)])
def test_last_k_buffers_across_chunks(spark, k, halo):
    """Buffers that reach over the cuts of a user's stream, K beyond a chunk."""
    from factorcast.operators.history import last_k_buffer, replay_sequence
    rows = [(i, 1 if i % 3 else i % 4, i % 7, float(i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "idx long, user long, product int, rating double").repartition(4)
    want, queues = [], {}
    for i, u, p, r in rows:
        q = queues.setdefault(u, [])
        q.append((i, p, r))
        newest = q[::-1][:k] if k > 0 else []
        want += [(i, u, pos, *x, len(newest)) for pos, x in enumerate(newest)]
    got = last_k_buffer(df, k, halo_rows=halo, chunk_rows=16)
    cols = ["idx", "user", "pos", "b_idx", "b_product", "b_rating", "b_len"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want)
    steps = sorted((r.idx, r.step, r.b_idx) for r in replay_sequence(got).collect())
    assert steps == sorted((i, a * n + pos, b) for i, _, pos, b, _, _, n in want for a in range(2))


def test_counts_before_of_several_flags(spark):
    from factorcast.operators.ordering import counts_before
    rows = [(1 if i % 3 else i % 5, i, i % 2, int(i % 7 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "user long, idx long, a int, b int").repartition(3)
    for chunk, inclusive in ((1 << 20, False), (10, True), (1, False)):
        got = counts_before(df, "user", "idx", {"na": "a", "nb": "b"}, inclusive, {"tb": "b"}, chunk).collect()
        for r in got:
            mine = [x for x in rows if x[0] == r.user and (x[1] < r.idx or inclusive and x[1] == r.idx)]
            assert (r.na, r.nb) == (sum(x[2] for x in mine), sum(x[3] for x in mine))
            assert r.tb == sum(x[3] for x in rows if x[0] == r.user)
    plan = counts_before(df, "user", "idx", {"na": "a", "nb": "b"})._jdf.queryExecution().executedPlan().toString()
    # before reuse: the rows (twice, with their own repartition), totals by key, offsets
    assert plan.count("Exchange") <= 6
