"""CSV parsing rules (FIXTURES section 4.7) and derived tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from factorcast.sources import csv as CSV
from factorcast.sources import sinks as SK
from factorcast.sources.store import VersionedTable


def _write(text):
    d = tempfile.mkdtemp(prefix="fc-csv-")
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


GOOD = "1,10,4.5,1000\n1,11,3.0,1001\n2,10,5.0,1002\n"


def test_ratings_good(spark):
    rows = CSV.read_ratings(spark, _write(GOOD)).orderBy("seq").collect()
    assert [(r.user, r.product, r.rating, r.timestamp) for r in rows] == [
        (1, 10, 4.5, 1000), (1, 11, 3.0, 1001), (2, 10, 5.0, 1002)]
    assert [r.seq for r in rows] == sorted(r.seq for r in rows)


MALFORMED = [
    "user,product,rating,timestamp\n" + GOOD,   # header
    "1,10,4.5\n",                               # 3 fields
    "1,10,4.5,1000,7\n",                        # 5 fields
    " 1,10,4.5,1000\n",                         # leading blank
    "1, 10,4.5,1000\n",
    "1,,4.5,1000\n",                            # empty field
    "1,10,4.5,1000,\n",                         # trailing comma
    "x,10,4.5,1000\n",                          # bad numbers
    "1,10,four,1000\n",
    "3000000000,10,4.5,1000\n",                 # out of range
]


@pytest.mark.parametrize("text", MALFORMED)
def test_malformed_ratings_fail_whatever_is_asked(spark, text):
    """Also where no column is needed, as in a count."""
    path = _write(GOOD + text)
    for ask in (lambda d: d.count(), lambda d: d.collect(), lambda d: d.select("user").collect(),
                lambda d: d.agg(F.max("product")).collect()):
        with pytest.raises(Exception, match="malformed line in .*r.csv"):
            ask(CSV.read_ratings(spark, path))


@pytest.mark.parametrize("text", ["1,10,4.5,1000\n", "G,1,10\n", ",1,10,1000\n", "G,1,10,1000,5\n",
                                  "G, 1,10,1000\n", "G,1,,1000\n", "code,user,product,timestamp\n"])
def test_malformed_feedback_fails_whatever_is_asked(spark, text):
    path = _write("G,1,10,1000\n" + text)
    for ask in (lambda d: d.count(), lambda d: d.collect()):
        with pytest.raises(Exception, match="malformed line in"):
            ask(CSV.read_feedback(spark, path))


def test_blank_line_skipped(spark):
    assert CSV.read_ratings(spark, _write("1,10,4.5,1000\n\n2,10,5.0,1002\n")).count() == 2


def test_feedback_order_and_code(spark):
    rows = CSV.read_feedback(spark, _write("G,1,10,1000\nP,1,11,1001\nG,2,10,1002\n")).orderBy("seq").collect()
    assert [(r.user, r.product, r.rating, r.timestamp) for r in rows] == [
        (1, 10, 1.0, 1000), (1, 11, 0.0, 1001), (2, 10, 1.0, 1002)]


def test_versioned_table_reads_and_drops_versions(spark):
    """Every kept version equals a plain dict of it; old folders go; a rerun of
    the last version changes nothing; only wanted buckets are opened."""
    store = VersionedTable(spark, SK.scratch_path(spark, "t-store"), "id long, f array<double>", ["id"],
                           buckets=4, compact_every=3)
    want, state = {}, {}
    for v in range(11):
        changed = {i: [float(v), float(i)] for i in range(30) if (i * 7 + v) % 5 == 0 or v == 0}
        state = state | changed
        want[v] = state
        rows = spark.createDataFrame(list(changed.items()), "id long, f array<double>")
        store.write(v, rows)
        store.write(v, rows)                       # as after a failure
        for kept in {v, max(v - 1, 0)}:
            assert {r.id: list(r.f) for r in store.read(kept).collect()} == want[kept], (v, kept)
    assert store.versions() == [8, 9, 10]
    with pytest.raises(ValueError, match="version 4"):
        store.read(4)
    some = store.read(10, spark.createDataFrame([(3,), (99,)], "id long"))
    assert [(r.id, list(r.f)) for r in some.collect()] == [(3, want[10][3])]
    names = os.listdir(store.root.removeprefix("file:"))
    assert sorted(names) == ["base-8", "delta-10", "delta-9"]


def test_versioned_pairs_and_empty_version(spark):
    seen = VersionedTable(spark, SK.scratch_path(spark, "t-seen"), "user long, product long", ["user", "product"])
    seen.write(0, spark.createDataFrame([], "user long, product long"))
    assert seen.read(0).count() == 0
    seen.write(1, spark.createDataFrame([(1, 2), (1, 3)], "user long, product long"))
    seen.write(2, spark.createDataFrame([(1, 2), (4, 5)], "user long, product long"))
    assert sorted(map(tuple, seen.read(2).collect())) == [(1, 2), (1, 3), (4, 5)]
    assert sorted(map(tuple, seen.read(1, spark.createDataFrame([(4,), (1,)], "user long")).collect())) == [
        (1, 2), (1, 3)]


def test_metrics_of_a_rerun_replace_their_own(spark):
    path = SK.scratch_path(spark, "t-metrics")
    one = spark.createDataFrame([(None, 3, 0.5)], "round long, n long, rmse double")
    two = spark.createDataFrame([(1, 2, 0.25), (2, 2, 0.75)], "round long, n long, rmse double")
    for run, protocol, rows in (("a", "x", one), ("a", "y", two), ("b", "x", two), ("a", "x", one)):
        SK.write_metrics(rows, path, run, protocol, 7)
    got = SK.read_metrics(spark, path).groupBy("run", "protocol").count().collect()
    assert {(r.run, r.protocol): r["count"] for r in got} == {("a", "x"): 1, ("a", "y"): 2, ("b", "x"): 2}
    assert SK.read_metrics(spark, path).where("run = 'a' AND protocol = 'x'").first().train_ms == 7
