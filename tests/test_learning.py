"""Learning operators against plain sequential numpy goldens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorcast.operators import train as TR
from factorcast.plans import protocols as P
from factorcast.sources import tables as S
from golden import SeqModel, dot

K = 4
GU, GI, LAM = 0.05, 0.04, 0.02

# three users x four products, 12 ratings (fixture 1) in stream order
ROWS = [(u, p, float((u * 3 + p) % 5 + 1), i)
        for i, (u, p) in enumerate([(u, p) for p in range(4) for u in range(3)])]


@pytest.fixture(scope="module")
def fx(spark):
    return spark.createDataFrame(ROWS, "user long, product long, rating double, idx long")


def _vecs(df):
    return {r.id: np.array(r.f) for r in df.collect()}


def _close(got, want):
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(got[i], want[i], rtol=0, atol=1e-12), i


def test_block_sgd_single_block_is_sequential(spark, fx):
    uf, pf = TR.block_sgd(fx, K, 2, GU, GI, LAM, blocks=1, order_cols=["idx"], shuffle=False)
    g = SeqModel(K)
    for _ in range(2):
        for u, p, r, _i in ROWS:
            g.step(u, p, r, 1, GU, GI, LAM)
    _close(_vecs(uf), g.u)
    _close(_vecs(pf), g.p)


def test_block_sgd_strata_equal_block_ordered_replay(spark, fx):
    d = 2
    blk = {r.user: r.b for r in fx.select("user", TR.block_of("user", d).alias("b")).distinct().collect()}
    pblk = {r.product: r.b for r in fx.select("product", TR.block_of("product", d).alias("b")).distinct().collect()}
    uf, pf = TR.block_sgd(fx, K, 1, GU, GI, LAM, blocks=d, order_cols=["idx"], shuffle=False)
    g = SeqModel(K)
    for s in range(d):
        for b in range(d):
            for u, p, r, _i in ROWS:
                if blk[u] == b and pblk[p] == (b + s) % d:
                    g.step(u, p, r, 1, GU, GI, LAM)
    _close(_vecs(uf), g.u)
    _close(_vecs(pf), g.p)


def test_online_update_warm_start_steps(spark, fx):
    uf0, pf0 = TR.block_sgd(fx.where("idx < 4"), K, 1, GU, GI, LAM, blocks=1, order_cols=["idx"], shuffle=False)
    uf, pf = TR.online_update(fx.where("idx >= 4"), uf0, pf0, K, 3, GU, GI, LAM, ["idx"], blocks=1)
    g = SeqModel(K)
    for u, p, r, i in ROWS:
        g.step(u, p, r, 1 if i < 4 else 3, GU, GI, LAM)
    _close(_vecs(uf), g.u)
    _close(_vecs(pf), g.p)


def test_last_k_replay_sequential(spark, fx):
    last_k = 2
    uf, pf = TR.last_k_replay(fx, K, last_k, GU, GI, LAM, blocks=1)
    g = SeqModel(K)
    queues = {}
    for u, p, r, _i in ROWS:
        q = queues.setdefault(u, [])
        q.append((p, r))
        del q[:-last_k]
        for _ in range(2):
            for pp, rr in reversed(q):
                g.step(u, pp, rr, 1, GU, GI, LAM)
    _close(_vecs(uf), g.u)
    _close(_vecs(pf), g.p)


def test_user_fold_in_frozen_products(spark, fx):
    from factorcast.sources.factors import init_factors
    pf = init_factors(fx, "product", K, "product")
    got = _vecs(TR.user_fold_in(fx, None, pf, K, 2, GU, LAM, ["idx"]))
    g = SeqModel(K)
    frozen = {r.id: np.array(r.f) for r in pf.collect()}
    for u, p, r, _i in ROWS:
        uf = g._get(g.u, u, 17)
        for _ in range(2):
            e = r - dot(uf, frozen[p])
            uf = uf + GU * (e * frozen[p] - LAM * uf)
        g.u[u] = uf
    _close(got, g.u)


@pytest.mark.parametrize("batch_rows", [1, 4, 100])
def test_prequential_scores_every_event_before_learning_it(spark, fx, batch_rows):
    """With one block the result is that of the event-by-event loop, whatever
    the micro-batch."""
    small = fx.where("idx < 8").withColumn("ts", F.col("idx"))
    m = P.eval_prequential(small, ["ts", "idx"], K, 2, GU, GI, LAM, batch_rows=batch_rows,
                           round_rows=3, n_blocks=4, blocks=1, shuffle_warmup=False).toPandas()
    g = SeqModel(K)
    rows = [r for r in ROWS if r[3] < 8]
    for _ in range(2):
        for u, p, r, i in rows[:2]:
            g.step(u, p, r, 1, GU, GI, LAM)
    se, cold = [], 0
    for u, p, r, i in rows[2:]:
        pr, c = g.predict(u, p)
        se.append((r - pr) ** 2)
        cold += c
        g.step(u, p, r, 2, GU, GI, LAM)
    overall = m[m["round"].isna()].iloc[0]
    assert overall["n"] == 6 and overall["unknown"] == cold
    assert abs(overall["rmse"] - np.sqrt(np.mean(se))) < 1e-12
    rounds = m[m["round"].notna()].sort_values("round")
    assert list(rounds["round"]) == [1, 2]
    assert abs(rounds["rmse"].iloc[0] - np.sqrt(np.mean(se[:3]))) < 1e-12


@pytest.mark.parametrize("batch_rows", [1, 3, 100])
def test_prequential_last_k_scores_before_the_replay(spark, fx, batch_rows):
    small = fx.withColumn("ts", F.col("idx"))
    m = P.eval_prequential_last_k(small, ["ts", "idx"], K, 2, GU, GI, LAM, batch_rows=batch_rows,
                                  round_rows=100, n_blocks=4, blocks=1).toPandas()
    g, queues, se, cold = SeqModel(K), {}, [], 0
    for u, p, r, i in ROWS:
        if i >= len(ROWS) // 4:
            pr, c = g.predict(u, p)
            se.append((r - pr) ** 2)
            cold += c
        q = queues.setdefault(u, [])
        q.append((p, r))
        del q[:-2]
        for _ in range(2):
            for pp, rr in reversed(q):
                g.step(u, pp, rr, 1, GU, GI, LAM)
    overall = m[m["round"].isna()].iloc[0]
    assert overall["n"] == len(se) and overall["unknown"] == cold
    assert abs(overall["rmse"] - np.sqrt(np.mean(se))) < 1e-12


def _rounds(rows, n_blocks):
    """(round, rows before its block, rows of its block) in stream order."""
    edge = [int(len(rows) / n_blocks * i) for i in range(n_blocks + 1)]
    return [(i, rows[:edge[i]], rows[edge[i]:edge[i + 1]]) for i in range(1, n_blocks)]


@pytest.mark.parametrize("batch_rows", [1, 2, 100])
def test_expanding_online_equals_the_loop(spark, fx, batch_rows):
    """A fresh model each round, each row scored before it is learned."""
    m = P.eval_expanding_online(fx.withColumn("ts", F.col("idx")), ["ts", "idx"], K, 1, GU, GI, LAM,
                                n_blocks=4, batch_rows=batch_rows, blocks=1).toPandas().set_index("round")
    for i, before, block in _rounds(ROWS, 4):
        keys = spark.createDataFrame([(i, r[3]) for r in before], "round long, idx long").select(
            "idx", TR.shuffle_key(["round", "idx"], P.config.SEED, 0).alias("key")).collect()
        at = {r.idx: r.key for r in keys}
        g, se, cold = SeqModel(K), [], 0
        for u, p, r, _ in sorted(before, key=lambda r: at[r[3]]):
            g.step(u, p, r, 1, GU, GI, LAM)
        firsts = {min(x[3] for x in ROWS if x[c] == y[c]) for y in ROWS for c in (0, 1)}
        for u, p, r, x in block:
            v = 3.5 if x in firsts else dot(g._get(g.u, u, 17), g._get(g.p, p, 71))
            cold += x in firsts
            se.append((r - v) ** 2)
            g.step(u, p, r, 1, GU, GI, LAM)
        assert m.loc[i, "n"] == len(block) and m.loc[i, "unknown"] == cold
        assert abs(m.loc[i, "rmse"] - np.sqrt(np.mean(se))) < 1e-12


def test_expanding_online_emits_every_round(spark, fx):
    m = P.eval_expanding_online(fx.withColumn("ts", F.col("idx")), ["ts", "idx"], K, 1, GU, GI, LAM,
                                n_blocks=50, batch_rows=4, blocks=2).toPandas()
    assert sorted(m["round"]) == list(range(1, 50))
    assert m["n"].sum() == fx.count() - len([r for r in ROWS if r[3] < fx.count() // 50])


def test_expanding_with_sgd_equals_the_loop(spark, fx):
    """E3 with a step per rating: fresh models, cold rows at 3.5."""
    m = P.eval_expanding(fx.withColumn("ts", F.col("idx")), ["ts", "idx"], K, 2, GU, LAM, n_blocks=4,
                         trainer="sgd", blocks=1).toPandas().set_index("round")
    for i, before, block in _rounds(ROWS, 4):
        g = SeqModel(K)
        for epoch in range(2):
            keys = spark.createDataFrame([(i, r[3]) for r in before], "round long, idx long").select(
                "idx", TR.shuffle_key(["round", "idx"], P.config.SEED, epoch).alias("key")).collect()
            at = {r.idx: r.key for r in keys}
            for u, p, r, _ in sorted(before, key=lambda r: at[r[3]]):
                g.step(u, p, r, 1, GU, GU, LAM)
        pred = [g.predict(u, p) for u, p, _, _ in block]
        assert m.loc[i, "unknown"] == sum(c for _, c in pred)
        se = [(r[2] - v) ** 2 for r, (v, _) in zip(block, pred)]
        assert abs(m.loc[i, "rmse"] - np.sqrt(np.mean(se))) < 1e-12
    with pytest.raises(ValueError, match="trainer"):
        P.eval_holdout(fx, ["idx"], K, 1, trainer="other")


def test_hot_user_goes_to_more_than_one_task(spark):
    """A user with a third of all rows is split over the product blocks, and
    the grid learns every row once."""
    rows = [(0 if i % 3 == 0 else 1 + i % 40, i % 60, 1.0 + i % 5, i) for i in range(600)]
    df = spark.createDataFrame(rows, "user long, product long, rating double, idx long")
    cells = df.where("user = 0").select(TR.block_of("product", 8).alias("b")).distinct().count()
    assert cells > 4
    uf, pf = TR.online_update(df, *TR.split_factors(TR.combine_factors(None, None, spark)), K, 1,
                              GU, GI, LAM, ["idx"], blocks=8)
    assert uf.count() == len({r[0] for r in rows}) and pf.count() == 60


def test_batch_gd_rmse_falls(spark):
    from factorcast.operators.metrics import rmse
    from factorcast.operators.recommend import predict
    from paths import SF001
    r = S.ratings(spark, SF001)
    prev = None
    for epochs in (0, 2, 4):
        uf, pf = TR.batch_gd(r, K, epochs, 0.05, 0.02)
        e = rmse(predict(r.select("user", "product", "rating"), uf, pf, K)).first()["rmse"]
        if prev is not None:
            assert e < prev
        prev = e


def test_exact_prediction_value_not_counted_as_unknown(spark):
    """A genuine prediction of 3.5 is not cold: the flag, not the value, counts."""
    from factorcast.operators.recommend import predict
    uf = spark.createDataFrame([(1, [1.75, 1.0])], "id long, f array<double>")
    pf = spark.createDataFrame([(2, [2.0, 0.0])], "id long, f array<double>")
    pairs = spark.createDataFrame([(1, 2, 4.0), (1, 3, 4.0)], "user long, product long, rating double")
    got = {r.product: (r.prediction, r.is_cold) for r in predict(pairs, uf, pf, 2).collect()}
    assert got == {2: (3.5, False), 3: (3.5, True)}


def test_batch_gd_salted_hot_users_same_result(spark):
    """Salting hot users (tiny threshold: every user is hot) changes only
    the partitioning, not the factors."""
    from paths import SF001
    r = S.ratings(spark, SF001)
    a_u, a_p = TR.batch_gd(r, K, 2, 0.05, 0.02)
    spark.conf.set(TR.HOT_ROWS_CONF, "2")
    try:
        b_u, b_p = TR.batch_gd(r, K, 2, 0.05, 0.02)
    finally:
        spark.conf.unset(TR.HOT_ROWS_CONF)
    for a, b in ((a_u, b_u), (a_p, b_p)):
        va, vb = _vecs(a), _vecs(b)
        assert set(va) == set(vb)
        for i in va:
            assert np.allclose(va[i], vb[i], rtol=0, atol=1e-12)


def test_block_sgd_touched_split_same_result(spark, fx):
    """A model above the broadcast limit is split into touched / untouched
    vectors; the result must equal the whole-model path."""
    uf0, pf0 = TR.block_sgd(fx.where("idx < 6"), K, 1, GU, GI, LAM, blocks=1, order_cols=["idx"], shuffle=False)
    batch = fx.where("idx >= 6 AND user < 2")
    a_u, a_p = TR.online_update(batch, uf0, pf0, K, 2, GU, GI, LAM, ["idx"], blocks=2)
    spark.conf.set("factorcast.broadcastMaxBytes", "10")
    try:
        b_u, b_p = TR.online_update(batch, uf0, pf0, K, 2, GU, GI, LAM, ["idx"], blocks=2)
        bu, bp = _vecs(b_u), _vecs(b_p)
    finally:
        spark.conf.unset("factorcast.broadcastMaxBytes")
    _close(bu, _vecs(a_u))
    _close(bp, _vecs(a_p))
    assert set(bu) == set(_vecs(uf0))        # untouched user 2 carried over


def test_block_stream_memory_does_not_follow_the_ratings(spark, monkeypatch):
    """A block's ratings pass through a bounded buffer; the result is that of
    one piece, over buffers, batches and blocks."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 12)), int(rng.integers(0, 9)), float(rng.integers(1, 6)), i)
            for i in range(700)]
    rows += [(0, int(rng.integers(0, 9)), 3.0, 700 + i) for i in range(350)]      # a third: one user
    df = spark.createDataFrame(rows, "user long, product long, rating double, idx long")
    g = SeqModel(K)
    for u, p, r, _i in rows:
        g.step(u, p, r, 2, GU, GI, LAM)
    for buffer, batch in ((64, "50"), (1 << 16, "10000")):
        monkeypatch.setattr(TR, "BUFFER_ROWS", buffer)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            uf, pf = TR.block_sgd(df, K, 1, GU, GI, LAM, blocks=1, order_cols=["idx"],
                                  steps_per_row=2, shuffle=False)
            _close(_vecs(uf), g.u)
            _close(_vecs(pf), g.p)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("blocks", [2, 3, 7])
def test_grid_is_an_argument_of_the_call(spark, fx, blocks):
    uf, pf = TR.block_sgd(fx, K, 2, GU, GI, LAM, blocks=blocks, order_cols=["idx"], shuffle=False)
    ub = {r.user: r.b for r in fx.select("user", TR.block_of("user", blocks).alias("b")).collect()}
    pb = {r.product: r.b for r in fx.select("product", TR.block_of("product", blocks).alias("b")).collect()}
    g = SeqModel(K)
    for _ in range(2):
        for s in range(blocks):
            for u, p, r, _i in ROWS:
                if (pb[p] - ub[u]) % blocks == s:
                    g.step(u, p, r, 1, GU, GI, LAM)
    _close(_vecs(uf), g.u)
    _close(_vecs(pf), g.p)


@pytest.mark.parametrize("chunk,buffer", [("1000000", 1 << 14), ("7", 5), ("1", 3)])
def test_user_fold_in_splits_a_user(spark, monkeypatch, chunk, buffer):
    """A user with most rows is cut into chunks whose maps are composed; known
    start vectors, unknown products, several steps."""
    rng = np.random.default_rng(2)
    rows = [(1 if i % 4 else int(rng.integers(2, 9)), int(rng.integers(0, 12)),
             float(rng.integers(1, 6)), i) for i in range(150)]
    df = spark.createDataFrame(rows, "user long, product long, rating double, idx long").repartition(3)
    pf = {p: rng.random(K) for p in range(10)}
    uf = {u: rng.random(K) for u in (1, 3, 50)}
    vectors = lambda d: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()],
                                              "id long, f array<double>")
    from golden import init_vec
    want = {}
    for u, p, r, _i in rows:
        v = want.get(u, uf.get(u))
        v = init_vec(u, K, 17, 5.0) if v is None else v
        q = pf[p] if p in pf else init_vec(p, K, 71, 5.0)
        for _ in range(3):
            v = v + GU * ((r - dot(v, q)) * q - LAM * v)
        want[u] = v
    monkeypatch.setattr(TR, "FOLD_BUFFER", buffer)
    spark.conf.set(TR.FOLD_CHUNK_CONF, chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = _vecs(TR.user_fold_in(df, vectors(uf), vectors(pf), K, 3, GU, LAM, ["idx"]))
    finally:
        spark.conf.unset(TR.FOLD_CHUNK_CONF)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    _close(got, want)


def test_expanding_rounds_in_groups(spark, fx):
    """Rounds trained in groups that fit the broadcast limit: same metrics."""
    rows = fx.withColumn("ts", F.col("idx"))

    def run(limit):
        spark.conf.set("factorcast.broadcastMaxBytes", limit)
        try:
            m = P.eval_expanding(rows, ["ts", "idx"], K, 2, GU, LAM, n_blocks=6).collect()
        finally:
            spark.conf.unset("factorcast.broadcastMaxBytes")
        return sorted((r["round"], r.lo, r.hi, r.n, r.unknown, round(r.rmse, 12)) for r in m)

    per_round = 4 * (40 + 8 * K)          # four products
    one = run(str(1 << 26))
    assert len(one) == 5 and run(str(per_round)) == run(str(2 * per_round)) == run("10") == one


def test_strata_of_an_epoch_are_one_job_without_null_vectors(spark, fx, monkeypatch):
    """One checkpoint an epoch, not one a stratum; scores pass through later
    strata; ratings travel with empty vectors (runs of null arrays take
    quadratic time to write to Arrow)."""
    kept, stream = [], TR._block_stream

    def watched(*args, **kw):
        learn, schema = stream(*args, **kw)

        def checked(batches):
            def whole():
                for batch in batches:
                    assert batch.column("f").null_count == 0
                    yield batch
            yield from learn(whole())
        return checked, schema

    monkeypatch.setattr(TR, "_block_stream", watched)
    materialize = TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda df, *a, **kw: kept.append(1) or materialize(df, *a, **kw))
    none = TR.combine_factors(None, None, spark)
    facs, scores = TR.block_sgd_table(fx, none, K, 2, GU, GI, LAM, 4, ["idx"], shuffle=False, score_id="idx")
    assert len(kept) == 2
    assert facs.count() == 7 and scores.count() == 2 * len(ROWS)


def test_mean_gradients_ship_one_count(spark):
    """One count for all elements of a gradient; rows without a rating count
    as rows only, an id without any gradient gets null."""
    from factorcast.operators.metrics import gradient_aggregate
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, None)], "id long, e double")
    out = gradient_aggregate(df, "id", [F.col("e"), F.col("e") * 3])
    assert sorted(map(tuple, out.collect())) == [(1, 3, 3.0, 9.0), (2, 1, None, None)]
    assert "avg(" not in out._jdf.queryExecution().executedPlan().toString()


def _by_batch(rows, facs, batches, keys, trail, blocks, **kw):
    """One call a micro-batch."""
    seen = []
    for j in range(batches):
        facs, scores = TR.score_and_learn(rows.where(F.col("batch") == j).drop("batch"), facs, K, 1, GU, GI, LAM,
                                          ["idx"], blocks=blocks, keys=keys, trail=trail, **kw)
        seen += scores.collect()
    return facs, seen


def _same_learning(spark, rows, batches, blocks, keys=None, trail=False, start=None):
    facs = start if start is not None else TR.combine_factors(None, None, spark, keys)
    want_f, want_s = _by_batch(rows, facs, batches, keys, trail, blocks)
    got_f, got_s = TR.score_and_learn(rows, facs, K, 1, GU, GI, LAM, ["idx"], blocks=blocks, keys=keys,
                                      trail=trail, batch_col="batch")
    assert sorted(map(tuple, got_f.collect())) == sorted(map(tuple, want_f.collect()))
    assert sorted(map(tuple, got_s.collect())) == sorted(map(tuple, want_s))
    assert len(want_s)


def test_many_micro_batches_learn_as_one_after_the_other(spark):
    """Bit for bit, with a user and a product of a third of the rows each (few
    blocks at the end) and rows that are in no stratum; known vectors count."""
    rows = [((i * 7) % 23 if i % 3 else 5, (i * 11) % 19 if i % 4 else 2, float(i % 9) / 2 + 0.5, i, i // 40)
            for i in range(160)]
    rows += [(None, 3, 1.0, 160, 3), (4, None, 2.0, 161, 3)]
    df = spark.createDataFrame(rows, "user long, product long, rating double, idx long, batch long")
    start = spark.createDataFrame([("u", 5, [0.1, 0.2, 0.3, 0.4]), ("p", 2, [0.5, 0.1, 0.2, 0.9]),
                                   ("p", 99, [1.0, 2.0, 3.0, 4.0])], "side string, id long, f array<double>")
    _same_learning(spark, df, 4, 4, start=start)
    _same_learning(spark, df, 4, 1, trail=True)


def test_many_sparse_micro_batches_and_keyed_models(spark, monkeypatch):
    """Ratings that share few ids finish in some rounds of all blocks; a buffer
    of few rows cuts a block's ratings; keyed models learn apart."""
    monkeypatch.setattr(TR, "BUFFER_ROWS", 16)
    sparse = spark.createDataFrame([((i * 37) % 101, (i * 53) % 97, float(i % 5) + 1, i, i // 25)
                                    for i in range(100)],
                                   "user long, product long, rating double, idx long, batch long")
    _same_learning(spark, sparse, 4, 4, trail=True)
    keyed = sparse.withColumn("round", F.col("idx") % 3).withColumn("user", F.col("user") % 7)
    _same_learning(spark, keyed, 4, 2, keys=["round"])


def test_round_groups_bound_the_replicated_ratings():
    """Where no round's product table fits a broadcast, a group replicates the
    ratings at most twice, whatever the number of rounds."""
    for n_blocks in (2, 5, 50):
        groups = P.round_groups(n_blocks, 0)
        assert [r for lo, hi in groups for r in range(lo, hi + 1)] == list(range(1, n_blocks))
        assert all(lo == hi or sum(range(lo, hi + 1)) <= 2 * n_blocks for lo, hi in groups)
    assert P.round_groups(50, 20) == [(1, 20), (21, 40), (41, 49)]


@pytest.mark.parametrize("blocks", [1, 4])
def test_dense_micro_batches_equal_one_call_each(spark, blocks, monkeypatch):
    """replays of many micro-batches, packed, leave the vectors and scores
    of one call a micro-batch, bit for bit; also where cells are cut into
    several packed rows, a micro-batch is empty, and ids or ratings are null."""
    rng = np.random.default_rng(6)
    rows = [(e, s, int(u), int(p), float(r), e if s == 0 else None)
            for e in range(60) for s in range(3)
            for u, p, r in [(rng.integers(1, 9), rng.integers(1, 12), rng.integers(1, 11) / 2)]]
    rows[20] = (*rows[20][:2], None, *rows[20][3:])
    rows[40] = (*rows[40][:3], None, *rows[40][4:])
    rows[-1] = (*rows[-1][:4], None, rows[-1][5])
    df = spark.createDataFrame(rows, "event long, step long, user long, product long, rating double, scored long")
    df = df.withColumn("batch", F.floor(F.col("event") / 8).cast("long")).where("batch <> 3").cache()
    known = spark.createDataFrame([("u", 1, [0.5] * K), ("u", 99, [0.25] * K), ("p", 2, [0.75] * K)],
                                  "side string, id long, f array<double>")
    facs, want = known, {}
    for b in range(8):
        facs, scores = TR.score_and_learn(df.where(F.col("batch") == b), facs, K, 1, GU, GI, LAM,
                                          ["event", "step"], score_id="scored", blocks=blocks)
        want |= {r.scored: repr(r.score) for r in scores.collect()}
    # wave order holds in a cell whatever rows it is cut into
    monkeypatch.setattr(TR, "PACKED_VALUES", 2 * K)
    got, scores = TR.score_and_learn(df, known, K, 1, GU, GI, LAM, ["event", "step"], score_id="scored",
                                     blocks=blocks, batch_col="batch", dense=True)
    assert {r.scored: repr(r.score) for r in scores.collect()} == want

    def table(f):
        return sorted((r.side, r.id, repr(list(r.f))) for r in f.collect())
    assert table(got) == table(facs)


def test_packed_cells_are_cut_in_order():
    """a cell above the buffer is several packed rows, numbered, whose waves
    end to end are the sequence; a new cell starts anew."""
    import pyarrow as pa
    n = TR.BUFFER_ROWS + 5
    batch = pa.RecordBatch.from_pydict({
        "batch_": np.zeros(n + 1, np.int64), "stratum": np.r_[np.zeros(n, np.int32), np.int32(1)],
        "g": np.zeros(n + 1, np.int32), "id": pa.array([None, *range(n)], pa.int64()),
        "user": np.arange(n + 1) // 2, "product": np.arange(n + 1), "rating": np.ones(n + 1)})
    got = [r.to_pylist()[0] for r in TR._pack_cells(iter([batch.slice(0, 9), batch.slice(9)]))]
    assert [(r["stratum"], r["seq"]) for r in got] == [(0, 0), (0, 1), (1, 0)]
    assert [p for r in got for p in sorted(r["products"])] == list(range(n + 1))
    assert all(len(r["users"]) <= TR.BUFFER_ROWS for r in got) and max(got[0]["level"]) == 1


def test_prequential_last_k_learns_many_micro_batches_a_step(spark, fx, monkeypatch):
    """the steps follow the rows, not the micro-batches."""
    calls = []

    def counted(*args, **kw):
        calls.append(1)
        return TR.score_and_learn(*args, **kw)
    monkeypatch.setattr(P, "score_and_learn", counted)
    P.eval_prequential_last_k(fx.withColumn("ts", F.col("idx")), ["ts", "idx"], K, 2, GU, GI, LAM,
                              batch_rows=2, round_rows=100, n_blocks=4, blocks=2).collect()
    assert len(calls) == 1


def test_expanding_online_groups_bound_rows_and_scratch(spark, monkeypatch):
    """Groups of few rounds: the same metrics as all rounds at once, no training
    on more than twice the ratings, and no written ratings are left."""
    import glob
    from factorcast.session import ensure_checkpoint_dir
    df = spark.createDataFrame([(i * 7 % 13, i * 5 % 11, float(i % 9) / 2 + 0.5, i) for i in range(90)],
                               "user long, product long, rating double, ts long")
    io = ensure_checkpoint_dir(spark).removeprefix("file:") + "/factorcast-io"

    def kept():
        return {f for kind in ("strata", "stream-rows", "rounds") for f in glob.glob(f"{io}/{kind}-*/**/*.parquet",
                                                                                   recursive=True)}

    def run(ratings=df):
        m = P.eval_expanding_online(ratings, ["ts"], K, 1, GU, GI, LAM, n_blocks=10, batch_rows=4, blocks=2)
        return sorted(map(tuple, m.collect()))

    trained, before = [], kept()
    train = P.block_sgd_table
    monkeypatch.setattr(P, "block_sgd_table", lambda tr, *a, **kw: trained.append(tr.count()) or train(tr, *a, **kw))
    whole = run()
    assert trained == [sum(9 * i for i in range(1, 10))]
    monkeypatch.setattr(P, "GROUP_ROWS", 0)
    trained.clear()
    assert run() == whole and len(whole) == 9
    assert len(trained) > 2 and max(trained) <= 2 * 90
    assert kept() == before
    assert [r[3] for r in run(df.where("ts < 5"))] == [1, 0] * 4 + [1]      # groups without test rows
