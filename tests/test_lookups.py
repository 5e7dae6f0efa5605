"""Plans of the vector lookups and of the metrics log."""

import pytest
from pyspark.sql import functions as F

from factorcast.plans import catalog as C
from factorcast.session import BROADCAST_MAX_BYTES_CONF
from factorcast.sources import factors as FA
from factorcast.sources import sinks as SK

ROWS = [(1, 10), (1, 11), (2, 10), (2, 10), (None, 10), (3, None), (4, 12)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _vectors(spark, ids):
    return spark.createDataFrame([(i, [float(i), 0.5]) for i in ids], "id long, f array<double>")


@pytest.fixture
def unbroadcast(spark):
    """Tables as if they were too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", BROADCAST_MAX_BYTES_CONF)
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("pf_rows", [None, 2])
def test_rows_with_a_vector_are_not_sorted(spark, unbroadcast, pf_rows):
    df = spark.createDataFrame(ROWS, "user long, product long")
    got = FA.lookup_factors(df, _vectors(spark, [1, 2, 3]), _vectors(spark, [10, 11]), k=2, pf_rows=pf_rows)
    assert _plan(got).count("ShuffledHashJoin") == 1
    found = sorted(((r.user, r.product, r.uf and r.uf[0], r.pf and r.pf[0]) for r in got.collect()), key=repr)
    assert found == sorted([(u, p, float(u) if u in (1, 2, 3) else None, float(p) if p in (10, 11) else None)
                            for u, p in ROWS], key=repr)


def test_small_products_are_broadcast(spark):
    df = spark.createDataFrame(ROWS, "user long, product long")
    got = FA.lookup_factors(df, _vectors(spark, [1]), _vectors(spark, [10]), k=2, pf_rows=1)
    assert "BroadcastHashJoin" in _plan(got) and "ShuffledHashJoin" not in _plan(got)


def test_metrics_are_evaluated_once(spark, monkeypatch):
    """The three writes of a protocol read its metrics, they do not evaluate it."""
    one = spark.createDataFrame([(1, 2, 0, 0.5, 0.5)], "round long, n long, unknown long, rmse double, recall double")
    lazy = one.join(one.select(F.col("round")), "round")
    vectors = _vectors(spark, [1])
    monkeypatch.setattr(C, "_first_block", lambda *a: (one, one))
    monkeypatch.setattr(C, "_ratings", lambda *a: one)
    monkeypatch.setattr(C, "_init_from", lambda *a: (vectors, vectors))
    monkeypatch.setattr(C, "_e8", lambda *a: one)
    monkeypatch.setattr(C, "q_round_rmse", lambda *a: lazy.select("round", "n", "rmse"))
    monkeypatch.setattr(C.P, "eval_holdout", lambda *a: lazy.select("n", "unknown", "rmse"))
    monkeypatch.setattr(C.RC, "predict", lambda *a: one)
    monkeypatch.setattr(C.M, "rmse", lambda *a: lazy.select("n", "unknown", "rmse"))
    monkeypatch.setattr(C.P, "recall_metrics", lambda *a: lazy.select("round", "n", "recall"))
    plans, write = [], SK.write_metrics
    monkeypatch.setattr(SK, "write_metrics", lambda rows, *a: plans.append(_plan(rows)) or write(rows, *a))
    assert C.q_metrics_log(spark, "").count() == 4
    assert len(plans) == 12 and not any("Join" in p for p in plans)
