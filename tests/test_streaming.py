"""Streaming: replayed micro-batches are idempotent; the stream covers every row."""

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from factorcast.operators import ordering as OR
from factorcast.sources import sinks as SK
from factorcast.sources import tables as S
from factorcast.sources.store import factor_store
from factorcast.streaming import online as ST
from factorcast.operators.train import block_sgd
from paths import SF001

K = 4


def _ratings_indexed(spark):
    return OR.global_index(S.ratings(spark, SF001), S.RATINGS_ORDER).select("idx", "user", "product", "rating")


def _version(spark, root, version):
    return sorted((r.id, tuple(r.f)) for r in factor_store(spark, root, "user").read(version).collect())


def test_prequential_batch_replay_is_idempotent(spark):
    ix = _ratings_indexed(spark)
    uf, pf = block_sgd(ix.where("idx < 100"), K, 1, 0.01, 0.01, 0.02, blocks=1, order_cols=["idx"])
    root, metrics = SK.scratch_path(spark, "t-f"), SK.scratch_path(spark, "t-m")
    ST.write_factors(uf, pf, root, 0)
    body = ST.PrequentialBatch(root, metrics, K, 1, 0.01, 0.01, 0.02)
    batch = ix.where("idx >= 100 AND idx < 400")
    body(batch, 0)
    first_u = _version(spark, root, 1)
    first_m = sorted(map(tuple, spark.read.parquet(metrics).collect()))
    body(batch, 0)                       # the same batch again, as after a failure
    assert _version(spark, root, 1) == first_u
    assert sorted(map(tuple, spark.read.parquet(metrics).collect())) == first_m


def test_stream_prequential_covers_every_row(spark):
    ix = _ratings_indexed(spark)
    n = ix.count()
    warm = n // 50
    uf, pf = block_sgd(ix.where(F.col("idx") < warm), K, 1, 0.01, 0.01, 0.02, blocks=1, order_cols=["idx"])
    size = -(-(n - warm) // 3)
    bounds = [(lo, min(lo + size, n)) for lo in range(warm, n, size)]
    root = ST.stage_stream(ix, "idx", bounds, SK.scratch_path(spark, "t-src"))
    out = ST.stream_prequential(ST.read_stream(spark, root, ix.schema), uf, pf, K, 1, 0.01, 0.01, 0.02)
    rows = sorted(out.collect(), key=lambda r: r.batch)
    assert [(r.lo, r.hi) for r in rows] == bounds          # consumed in stream order
    assert sum(r.n for r in rows) == n - warm


def test_stream_of_versions_equals_one_pass(spark):
    """Deltas, merges and compaction over many micro-batches leave the vectors
    of learning the whole stream in one call."""
    ix = _ratings_indexed(spark).where("idx < 600")
    root, metrics = SK.scratch_path(spark, "t-v"), SK.scratch_path(spark, "t-vm")
    from factorcast.operators.train import empty_factors, online_update
    ST.write_factors(empty_factors(spark), empty_factors(spark), root, 0)
    body = ST.PrequentialBatch(root, metrics, K, 1, 0.01, 0.01, 0.02, blocks=1)
    for j in range(10):
        body(ix.where((F.col("idx") >= 60 * j) & (F.col("idx") < 60 * j + 60)), j)
    uf, _ = online_update(ix, empty_factors(spark), empty_factors(spark), K, 1, 0.01, 0.01, 0.02,
                          ["idx"], blocks=1)
    want = sorted((r.id, tuple(r.f)) for r in uf.collect())
    assert _version(spark, root, 10) == want
    assert spark.read.parquet(metrics).agg(F.sum("n")).first()[0] == 600


def test_stream_last_k_of_a_hot_user(spark, monkeypatch):
    from factorcast.operators.history import last_k_buffer
    monkeypatch.setattr(ST, "PIECE_ROWS", 7)
    rows = [(i, 1 if i % 3 else i % 4, i % 11, float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "idx long, user long, product long, rating double")
    root = ST.stage_stream(df, "idx", [(0, 90), (90, 200)], SK.scratch_path(spark, "t-lk"))
    got = ST.stream_last_k(ST.read_stream(spark, root, df.schema), 3)
    cols = ["idx", "user", "pos", "b_idx", "b_product", "b_rating"]
    want = last_k_buffer(df, 3).select(cols).collect()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want))


def test_stream_recommend_lists_are_those_of_each_version(spark):
    """Each micro-batch's lists equal the best unseen products by the vectors
    learned up to it."""
    from factorcast.operators.recommend import recommend_top_r
    from factorcast.operators.train import empty_factors, online_update
    rows = [(i, i % 5, (i * i) % 7, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, user long, product long, rating double")
    bounds = [(0, 20), (20, 45), (45, 60)]
    root = ST.stage_stream(df, "idx", bounds, SK.scratch_path(spark, "t-rec"))
    got = ST.stream_recommend(ST.read_stream(spark, root, df.schema), K, 1, 0.05, 0.05, 0.02, 2).collect()
    uf = pf = empty_factors(spark)
    want = []
    for j, (lo, hi) in enumerate(bounds):
        part = df.where((F.col("idx") >= lo) & (F.col("idx") < hi))
        uf, pf = online_update(part, uf, pf, K, 1, 0.05, 0.05, 0.02, ["idx"], implicit=True)
        best = recommend_top_r(uf, pf, K, 2, seen=df.where(F.col("idx") < hi), users=part)
        want += [(j, r.user, r.product, r.rank) for r in best.collect()]
    assert sorted((r.batch, r.user, r.product, r.rank) for r in got) == sorted(want) and want


def test_staging_reads_the_stream_once(spark):
    """Not once a micro-batch; a gap between bounds belongs to none."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    rows = spark.range(100).select(counted("id").alias("idx"), F.lit(1).alias("user"))
    bounds = [(lo, lo + 9) for lo in range(0, 100, 10)]
    root = ST.stage_stream(rows, "idx", bounds, SK.scratch_path(spark, "t-once"))
    assert seen.value <= 200
    for j, (lo, hi) in enumerate(bounds):
        got = spark.read.parquet(f"{root}/batch-{j:06d}").collect()
        assert sorted(r.idx for r in got) == list(range(lo, hi))


def test_stream_last_k_shares_state_among_users(spark, monkeypatch):
    """Few state partitions and keys, whatever the users; null values stay null."""
    monkeypatch.setattr(ST, "PIECE_ROWS", 16)
    rows = [(i, None if i % 11 == 0 else i % 17, None if i % 13 == 0 else i % 5,
             None if i % 7 == 0 else float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, user long, product long, rating double")
    root = ST.stage_stream(df, "idx", [(0, 120), (120, 240), (240, 300)], SK.scratch_path(spark, "t-lkb"))
    paths = {}
    monkeypatch.setattr(ST, "scratch_path", lambda s, name: paths.setdefault(name, SK.scratch_path(s, name)))
    got = ST.stream_last_k(ST.read_stream(spark, root, df.schema), 3, buckets=2)
    want = {}
    for i, user, product, rating in rows:
        want.setdefault(user, []).append((i, product, rating))
    lists = [(b[j][0], u, pos, *b[j - pos]) for u, b in want.items() for j in range(len(b))
             for pos in range(min(3, j + 1))]
    key = lambda r: (r[0], r[2])
    cols = ["idx", "user", "pos", "b_idx", "b_product", "b_rating"]
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(lists, key=key)
    state = os.path.join(paths["st2-ckpt"].removeprefix("file:"), "state", "0")
    assert len([p for p in os.listdir(state) if p.isdigit()]) <= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_last_k_drops_a_user_that_long_after_its_last_rating():
    """Of users that share a state value only the one that came by stays."""
    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Time:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    p = ST.LastKProcessor(2, expire_ms=100)
    p.buf = Value()

    def feed(ms, *ratings):
        part = pd.DataFrame(ratings, columns=["idx", "user", "product"]).assign(rating=1.0, nulls=0)
        return [(r.idx, r.user, r.pos, r.b_idx) for f in p.handleInputRows((0,), iter([part]), Time(ms))
                for r in f.itertuples()]

    assert feed(1000, (0, 1, 5), (1, 2, 5)) == [(0, 1, 0, 0), (1, 2, 0, 1)]
    assert feed(1060, (2, 1, 6)) == [(2, 1, 0, 2), (2, 1, 1, 0)]
    assert feed(1120, (3, 2, 7), (4, 1, 8)) == [(4, 1, 0, 4), (4, 1, 1, 2), (3, 2, 0, 3)]


def test_staged_files_are_as_old_as_their_batches(spark):
    bounds = [(lo, lo + 10) for lo in range(0, 100, 10)]
    root = ST.stage_stream(spark.range(100).withColumnRenamed("id", "idx"), "idx", bounds,
                           SK.scratch_path(spark, "t-age")).removeprefix("file:")
    times = [{os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/batch-{j:06d}/*.parquet")} for j in range(10)]
    assert all(len(glob.glob(f"{root}/batch-{j:06d}/*.parquet")) == ST.FILES for j in range(10))
    assert all(max(a) < min(b) for a, b in zip(times, times[1:]))


def test_staging_without_file_times_writes_the_batches_in_order(spark, monkeypatch):
    monkeypatch.setattr(ST, "_file_in_order", lambda *a: False)
    test_staging_reads_the_stream_once(spark)


def test_small_micro_batch_is_learned_by_one_task(spark, monkeypatch):
    """The same vectors and scores as stratum by stratum, one exchange each, also
    with rows that lack a user, a product or a rating."""
    from pyspark.sql import DataFrame
    from factorcast.operators.train import combine_factors, score_and_learn
    rows = [(i, None if i % 19 == 3 else i * 7 % 23, None if i % 17 == 5 else i * i % 13,
             None if i == 40 else float(i % 5)) for i in range(150)]
    df = spark.createDataFrame(rows, "idx long, user long, product long, rating double")
    warm, batch = df.where("idx < 60").where("user IS NOT NULL AND product IS NOT NULL"), df.where("idx >= 60")
    uf, pf = block_sgd(warm, K, 1, 0.05, 0.05, 0.02, order_cols=["idx"])
    old = combine_factors(uf.where("id % 4 > 0"), pf.where("id % 5 > 0"), spark)

    def learned(**known):
        facs, scores = score_and_learn(batch, old, K, 2, 0.05, 0.05, 0.02, ["idx"], **known)
        return (sorted((r.side, r.id, repr(r.f)) for r in facs.collect()),
                sorted((r.idx, repr(r.score)) for r in scores.collect()))

    want = learned()
    monkeypatch.setattr(DataFrame, "repartitionById", None)       # no exchange a stratum
    assert learned(n_rows=batch.count()) == want
    root, metrics = SK.scratch_path(spark, "t-one"), SK.scratch_path(spark, "t-onem")
    ST.write_factors(uf, pf, root, 0)
    ST.PrequentialBatch(root, metrics, K, 1, 0.05, 0.05, 0.02)(batch, 0)
    assert spark.read.parquet(metrics).select("n").first()[0] == len(want[1])


def test_recommend_micro_batch_has_no_stratum_exchange(spark, monkeypatch):
    """One task learns it, and its users' vectors are not read again."""
    from pyspark.sql import DataFrame
    rows = [(i, i % 5, i % 11, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "idx long, user long, product long, rating double")
    root, recs = SK.scratch_path(spark, "t-st3"), SK.scratch_path(spark, "t-st3r")
    empty = block_sgd(df.where("idx < 0"), K, 1, 0.05, 0.05, 0.02)
    ST.write_factors(*empty, root, 0)
    ST.seen_table(spark, root).write(0, spark.createDataFrame([], "user long, product long"))
    read, opened = ST.VersionedTable.read, []
    monkeypatch.setattr(ST.VersionedTable, "read",
                        lambda self, version, *a: opened.append((self.root[len(root) + 1:], version))
                        or read(self, version, *a))
    monkeypatch.setattr(DataFrame, "repartitionById", None)
    ST.RecommendBatch(root, recs, K, 1, 0.05, 0.05, 0.02, 3)(df, 0)
    assert sorted(opened) == [("product", 0), ("product", 1), ("seen", 1), ("user", 0)]
    assert spark.read.parquet(recs).select("user").distinct().count() == 5
