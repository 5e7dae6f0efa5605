"""Recall@R per event (E8) against a brute-force per-event ranking."""

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorcast.operators import recommend as RC
from factorcast.operators.recall import recall_at_events
from golden import dot

K = 2
R = 2


def brute(events, uf, pf):
    out = {}
    cat = sorted(pf)
    for i, (u, p, r) in enumerate(events):
        past = {q for (uu, q, _) in events[:i] if uu == u}
        fut = {q for (uu, q, rr) in events[i:] if uu == u and rr > 0.9}
        if u not in uf:
            out[i] = (0, len(fut), 0.0)
            continue
        if not fut:
            out[i] = (0, 0, None)
            continue
        cand = [q for q in cat if q not in past]
        cand.sort(key=lambda q: (-dot(uf[u], pf[q]), q))
        hits = len([q for q in cand[:R] if q in fut])
        out[i] = (hits, len(fut), hits / len(fut))
    return out


def test_recall_matches_bruteforce(spark):
    rng = np.random.default_rng(7)
    pf = {p: rng.random(K) for p in range(6)}
    pf[5] = pf[4].copy()          # tie at the top-R boundary: lower id wins
    uf = {u: rng.random(K) for u in range(3)}   # user 3 has no vector -> 0.0
    events = [(int(rng.integers(0, 4)), int(rng.integers(0, 6)), float(rng.integers(0, 2)))
              for _ in range(60)]
    events += [(0, 2, 1.0), (0, 2, 1.0), (1, 1, 0.0)]   # repeats; user 1 ends without positive
    ev = spark.createDataFrame([(i, u, p, r) for i, (u, p, r) in enumerate(events)],
                               "idx long, user long, product long, rating double")
    ufd = spark.createDataFrame([(u, v.tolist()) for u, v in uf.items()], "id long, f array<double>")
    pfd = spark.createDataFrame([(p, v.tolist()) for p, v in pf.items()], "id long, f array<double>")
    for chunk in (1 << 20, 5):
        got = {r.idx: (r.hits, r.n_future, r.recall)
               for r in recall_at_events(ev, ufd, pfd, K, R, chunk_rows=chunk).collect()}
        want = brute(events, uf, pf)
        assert set(got) == set(want)
        for i in want:
            gh, gn, gr = got[i]
            wh, wn, wr = want[i]
            assert (gh, gn) == (wh, wn), (i, got[i], want[i])
            assert (gr is None) == (wr is None) and (gr is None or abs(gr - wr) < 1e-12)


def test_catalogue_buckets_equal_single_bucket(spark):
    """Many small buckets and user blocks: same ranks, recall, top-R."""
    from factorcast.operators.ordering import global_index
    from factorcast.sources import factors as FA
    from factorcast.sources import tables as S
    from paths import SF001
    fi = global_index(S.feedback(spark, SF001), S.FEEDBACK_ORDER)
    uf = FA.init_factors(fi, "user", 8, "user", True)
    pf = FA.init_factors(fi, "product", 8, "product", True)

    def run():
        rec = recall_at_events(fi, uf, pf, 8, 3).select("idx", "hits", "n_future").collect()
        top = RC.recommend_top_r(uf, pf, 8, 3, seen=fi).select("user", "product", "rank").collect()
        return sorted(map(tuple, rec)), sorted(map(tuple, top))

    one = run()
    with small_buckets(spark):
        many = run()
    assert one == many


@contextmanager
def small_buckets(spark, bucket="7", block="5"):
    spark.conf.set(RC.BUCKET_CONF, bucket)
    spark.conf.set(RC.USER_BLOCK_CONF, block)
    try:
        yield
    finally:
        spark.conf.unset(RC.BUCKET_CONF)
        spark.conf.unset(RC.USER_BLOCK_CONF)


@pytest.mark.parametrize("top", [1, 4, 50, None])
@pytest.mark.parametrize("bucket", ["1", "7", "1000"])
def test_catalogue_search_is_exact(spark, top, bucket):
    """Equal scores, zero and opposite vectors, users that saw all or nothing,
    seen products without a vector: every score, and every best list, as a full
    sort gives them."""
    rng = np.random.default_rng(3)
    uf = {u: rng.integers(-2, 3, K).astype(float) for u in range(23)} | {99: np.zeros(K)}
    pf = {p: rng.integers(-2, 3, K) * 2.0 ** int(rng.integers(-3, 4)) for p in range(40)} | {77: np.zeros(K)}
    seen = {(u, p) for u in range(20) for p in range(41) if rng.random() < 0.3}
    seen |= {(5, p) for p in pf} | {(0, 1000), (1000, 0)}
    users = spark.createDataFrame([(u, v.tolist()) for u, v in uf.items()], "user long, uf array<double>")
    products = spark.createDataFrame([(p, v.tolist()) for p, v in pf.items()], "id long, f array<double>")
    pairs = spark.createDataFrame(sorted(seen) * 2, "user long, product long")
    with small_buckets(spark, bucket):
        got = RC.score_catalogue(users, products, K, top=top, seen=pairs).collect()
    want = set()
    for u, a in uf.items():
        row = sorted(((-sum(x * y for x, y in zip(a, b)), p) for p, b in pf.items() if (u, p) not in seen))
        want |= {(u, p, -s) for s, p in row[:top]}
    assert len(got) == len(want) and {(r.user, r.product, r.score) for r in got} == want


def test_catalogue_search_skips_buckets_out_of_reach(spark):
    """One long vector beats all short ones: only its bucket is searched."""
    pf = spark.createDataFrame([(p, [100.0 if p == 3 else 0.001, 0.0]) for p in range(50)],
                               "id long, f array<double>")
    with small_buckets(spark, "5"):
        catalogue = RC.Catalogue.of(pf, 2)
        assert len(catalogue.longest) == 10 and catalogue.longest[0] == 100.0
        reach = spark.createDataFrame([(1.0, 50.0), (1.0, 0.0005), (1.0, 0.0), (1.0, -1.0), (0.0, 0.0),
                                       (0.0, 1.0), (1.0, None)], "n double, s double")
        got = reach.select(catalogue.within_reach(reach["n"], reach["s"]).alias("b")).collect()
    assert [r.b for r in got] == [1, 10, 10, 10, 10, 0, 10]


def test_empty_catalogue_and_no_users(spark):
    pf = spark.createDataFrame([(1, [1.0] * K)], "id long, f array<double>")
    users = spark.createDataFrame([(1, [1.0] * K)], "user long, uf array<double>")
    assert RC.score_catalogue(users, pf.where("false"), K, top=3).count() == 0
    assert RC.score_catalogue(users.where("false"), pf, K, top=3, seen=users.select(
        "user", F.lit(1).alias("product"))).count() == 0


def learned_recall(events, k, r, steps, gu, gi, lam):
    """E7 as a plain loop: rank, then learn, event by event."""
    from golden import SeqModel
    g, out = SeqModel(k, 1.0), {}
    for i, (u, p, x) in enumerate(events):
        past = {q for uu, q, _ in events[:i] if uu == u}
        future = {q for uu, q, y in events[i:] if uu == u and y > 0.9}
        if u not in g.u:
            out[i] = (0, len(future), 0.0)
        else:
            cand = sorted((q for q in g.p if q not in past), key=lambda q: (-dot(g.u[u], g.p[q]), q))
            hits = len(future & set(cand[:r]))
            out[i] = (hits, len(future), hits / len(future) if future else None)
        g.step(u, p, x, steps, gu, gi, lam)
    return out


@pytest.mark.parametrize("chunk,part,batch", [(1 << 12, 1 << 16, 1 << 16), (7, 3, 20), (1, 1, 50)])
def test_recall_while_learning_equals_the_loop(spark, chunk, part, batch):
    """Whatever the chunks of events, parts of the catalogue and micro-batches;
    a user with a third of all events."""
    from factorcast.operators import recall as RL
    from factorcast.plans import protocols as P
    rng = np.random.default_rng(4)
    events = [(0 if i % 3 == 0 else int(rng.integers(1, 6)), int(rng.integers(0, 9)),
               float(rng.integers(0, 2))) for i in range(60)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(events)],
                               "seq long, user long, product int, rating double").repartition(3)
    real = RL.recall_along_trail
    P.recall_along_trail = lambda ev, k, r: real(ev, k, r, chunk, part)
    try:
        got = P.eval_prequential_recall(df, ["seq"], 3, 2, 0.3, 0.2, 0.02, r=R, batch_rows=batch).collect()
    finally:
        P.recall_along_trail = real
    want = learned_recall(events, 3, R, 2, 0.3, 0.2, 0.02)
    assert {r.idx: (r.hits, r.n_future, r.recall) for r in got} == want and len(got) == len(want)


def test_recall_while_learning_on_the_given_events(spark):
    """The registered parameters on whole tables, event after event."""
    from factorcast.plans import catalog as C
    from factorcast.plans import protocols as P
    from factorcast.sources import tables as S
    from paths import SF001
    fb = S.feedback(spark, SF001)
    got = P.eval_prequential_recall(fb, S.FEEDBACK_ORDER, C.K, 1, C.SGD_RATE, C.SGD_RATE, C.LAMBDA,
                                    r=C.TOP_R).collect()
    rows = [(r.user, r.product, r.rating) for r in fb.orderBy(*S.FEEDBACK_ORDER).collect()]
    want = learned_recall(rows, C.K, C.TOP_R, 1, C.SGD_RATE, C.SGD_RATE, C.LAMBDA)
    assert {r.idx: (r.hits, r.n_future, r.recall) for r in got} == want
    kept = [x[2] for x in want.values() if x[2] is not None]
    assert len(kept) == 983 and round(sum(kept) / len(kept), 6) == 0.051139


def test_interval_cover(spark):
    """A range of ordinals is cut into at most two aligned blocks a level."""
    from factorcast.operators.recall import dyadic_cover
    pairs = [(a, b) for b in range(0, 40) for a in range(0, b)] + [(5, 1 << 40), (0, 1 << 40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", dyadic_cover(F.col("a"), F.col("b")).alias("nodes")).collect():
        blocks = sorted((n.number << n.level, (n.number + 1) << n.level) for n in r.nodes)
        assert blocks[0][0] == r.a and blocks[-1][1] == r.b
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= 2 * max(1, (r.b - r.a).bit_length())


def test_intervals_meet_every_event_inside(spark):
    from factorcast.operators.recall import expand_intervals
    rng = np.random.default_rng(6)
    events = [(int(rng.integers(0, 4)) if i % 3 else 0, i) for i in range(0, 300, 2)]
    spans = [(int(rng.integers(0, 5)), p, int(lo), int(lo + rng.integers(-3, 200)))
             for p, lo in enumerate(rng.integers(-5, 310, 120))] + [(0, 500, 0, 1 << 62), (1, 501, 7, 7)]
    got = expand_intervals(spark.createDataFrame(spans, "user long, product long, lo long, hi long"),
                           spark.createDataFrame(events, "user long, idx long"), chunk_rows=16)
    want = sorted((u, i, p) for u, i in events for v, p, lo, hi in spans if u == v and lo <= i <= hi)
    assert sorted((r.user, r.idx, r["product"]) for r in got.collect()) == want
