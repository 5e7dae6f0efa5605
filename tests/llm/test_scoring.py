"""Language-model scores, clustering and filter audit against plain loops."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorcast.llm import filter_audit, lloyd, ppm, queries


# ---------------------------------------------------------------- PPM

class PlainPpm:
    """PPM of order 5, method C, symbol exclusion, by dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            data = b"\xfe" * 5 + t + b"\xff"
            for i in range(5, len(data)):
                for order in range(6):
                    self.seen[data[i - order:i]][data[i]] += 1

    def probability(self, context, symbol):
        p, excluded = Fraction(1), set()
        for order in range(5, -1, -1):
            counts = {s: n for s, n in self.seen.get(context[5 - order:], {}).items()
                      if s not in excluded}
            if not counts:
                continue
            room = sum(counts.values()) + len(counts)
            if symbol in counts:
                return p * Fraction(counts[symbol], room)
            p *= Fraction(len(counts), room)
            excluded |= set(counts)
        return p / (255 - len(excluded))

    def score(self, text):
        data = b"\xfe" * 5 + text + b"\xff"
        return sum(math.log10(self.probability(data[i - 5:i], data[i])) for i in range(5, len(data)))


def plain_scores(rows):
    """[(id, n_tokens, n_known, N, base, score)] of (id, text, train) rows."""
    data = [(i, (t or "").encode().lower(), bool(train)) for i, t, train in rows]
    model = PlainPpm([t for _, t, train in data if train])
    counts = Counter(w for _, t, train in data if train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, _ in data:
        c = [counts[w] for w in [*t.split(), None]]
        out.append((i, len(c), sum(x > 0 for x in c), n,
                    sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), model.score(t)))
    return out


def same_scores(found, want):
    def key(r):
        return (r[0] is None, r[0] or 0, *[round(x, 6) for x in r[1:]])

    found = sorted([tuple(r) for r in found], key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for a, b in zip(found, want):
        assert a[4] == pytest.approx(b[4], abs=1e-7) and a[5] == pytest.approx(b[5], abs=1e-7)


COLUMNS = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("piece,unit", [(1 << 23, 1 << 24), (7, 40), (1, 10)])
def test_ppm_equals_plain_loops(spark, piece, unit):
    """Whatever the cut into pieces and units, words that go over a cut included."""
    texts = ["the cat sat on the mat", "The CAT sat", "", None, "  \t\n", "x" * 50, "ab" * 40 + " tail",
             "the cat sat on the mat", "une été à la mer 漢字 🙂", "a\x0bb\x0cc\rd", "mat the on sat " * 9,
             " lead and trail ", "w" * 200 + " " + "w" * 200 + " end", "\x1cnot\x85a space "]
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(texts)] + [(None, "no id", None), (2, "the cat", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    found = ppm.score(df, F.col("train"), piece_bytes=piece, unit_bytes=unit)
    same_scores(found.select(COLUMNS).collect(), plain_scores(rows))


def test_ppm_probabilities_add_up_to_one():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"abc "), 30).tolist()) for _ in range(20)]
    data = [b"\xfe" * 5 + t + b"\xff" for t in texts]
    seen = Counter(int.from_bytes(d[i - 5:i + 1]) for d in data for i in range(5, len(d)))
    table = ppm.levels(0, ppm.TABLE, np.array(list(seen)), np.array(list(seen.values())), None)
    symbols = [s for s in range(256) if s != 0xFE]
    for head in (b"\xfe\xfe\xfe\xfe\xfe", b"abcab", b"zzabc", b"zzzzz", b"zc  b"):
        mine = np.array([int.from_bytes(head + bytes([s])) for s in symbols])
        near = [g for g in seen if g >> 8 & ppm.SUFFIX == int.from_bytes(head[2:])]
        gram = np.unique(np.array([*mine.tolist(), *near], np.int64))
        n = np.array([seen.get(int(g), 0) for g in gram])
        p = ppm.log_probabilities(gram, n, table)
        assert (10 ** p[np.isin(gram, mine)]).sum() == pytest.approx(1)


def test_ppm_windows_of_one_suffix_over_many_batches(spark, monkeypatch):
    """Shards work off whole suffixes whatever the batches."""
    rows = [(i, "aab" * i + "caab" * (i % 5), True) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(ppm, "SHARD_ROWS", 5)
    try:
        found = ppm.score(df, F.col("train"), unit_bytes=300).select(COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same_scores(found, plain_scores(rows))


def test_ppm_looks_words_up_slices_at_a_time(monkeypatch):
    """The vocabulary is hashed once for several slices; windows are found
    whatever their order."""
    calls, index_in = [], ppm.pc.index_in
    monkeypatch.setattr(ppm.pc, "index_in", lambda *a: calls.append(1) or index_in(*a))
    slices = [[b"a", b"c", b"a"], [], [b"", b"b", b"c"]]
    coded = [pa.array(s, pa.binary()).dictionary_encode() for s in slices]
    vocabulary = pa.chunked_array([pa.array([b"c", b""], pa.binary()), pa.array([b"a", b"b"], pa.binary())])
    found = [at.tolist() for at in ppm._in_vocabulary(coded, vocabulary)]
    assert found == [[2, 0, 2], [], [1, 3, 0]] and len(calls) == 1
    assert ppm._positions(np.array([3, 5, 9]), np.array([9, 3, 5, 3])).tolist() == [2, 0, 1, 0]


def test_ppm_edges(spark, edge, edge_rows, empty):
    found = ppm.score(edge, F.col("doc_id") % 2 == 0).select(COLUMNS).collect()
    same_scores(found, plain_scores([(r[0], r[1], r[0] is not None and r[0] % 2 == 0)
                                     for r in edge_rows]))
    untrained = ppm.score(edge, F.lit(False)).collect()
    assert len(untrained) == len(edge_rows) and {r["base_score"] for r in untrained} == {0.0}
    assert {r["n_known"] for r in untrained} == {0} and {r["train_tokens"] for r in untrained} == {0}
    assert ppm.score(empty, F.lit(True)).count() == 0


def test_op11_equals_plain_loops_on_whole_texts(spark, docs):
    got = {r["doc_id"]: r for r in queries.op11_ppm_score(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 10 != 0)
            for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for i, _, train in rows:
        assert got[i]["held_out"] == (not train)
    same_scores([[got[i][c] for c in COLUMNS] for i, _, _ in rows], plain_scores(rows))


# ---------------------------------------------------------------- Lloyd

def plain_lloyd(rows, k, rounds, dims, seed):
    """{position: (cluster, distance)}, centroids; Python integers."""
    kept = {}
    for at, (i, e) in enumerate(rows):
        if e is None or len(e) != dims or any(x is None or not math.isfinite(x) for x in e):
            continue
        if any(abs(x) * 1024 > 1 << 27 for x in e):
            continue
        kept[at] = [math.floor(1024 * x) for x in e]

    def digest(at):
        i = rows[at][0]
        return hashlib.sha256((seed + ("" if i is None else str(i))).encode()).hexdigest()

    cents = [kept[a] for a in sorted(kept, key=lambda a: (digest(a), kept[a]))[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = {a: nearest(x)[1] for a, x in kept.items()}
        for j in range(len(cents)):
            mine = [kept[a] for a in kept if of[a] == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return {a: nearest(x)[::-1] for a, x in kept.items()}, cents


def same_clusters(got, rows, want, cents):
    sums = Counter()
    for c, d in want.values():
        sums[c] += d
    expected = sorted((repr(rows[a][0]), c, d, sums[c], sum(sums.values()), cents[c])
                      for a, (c, d) in want.items())
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"],
                   list(r["centroid"])) for r in got) == expected


@pytest.mark.parametrize("dims,block", [(5, 2), (4, 4), (7, 16)])
def test_lloyd_equals_plain_loops(spark, dims, block):
    """Ties, copies, a hot value, empty clusters; blocks that do not divide the columns."""
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dims) / 7]) for i in range(120)]
    rows += [(200 + i, [0.25] * dims) for i in range(70)] + [(5, [0.25] * dims), (None, [1.0] * dims)]
    rows += [(301, None), (302, [1.0]), (303, [None] * dims), (304, [float("nan")] * dims),
             (305, [float("inf")] + [0.0] * (dims - 1)), (306, [1e30] * dims), (307, [0.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "cluster", F.lit("clash")).withColumn("row", F.lit(1)).repartition(5)
    got = lloyd.cluster(df, k=6, rounds=4, dims=dims, seed="3:", block=block).collect()
    same_clusters(got, rows, *plain_lloyd(rows, 6, 4, dims, "3:"))


def test_lloyd_fewer_vectors_than_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same_clusters(lloyd.cluster(df, 8, 2, 2, "3:").collect(), rows, *plain_lloyd(rows, 8, 2, 2, "3:"))
    none = lloyd.cluster(df.where("false"), 8, 2, 2, "3:")
    assert none.count() == 0 and "centroid" in none.columns


# ---------------------------------------------------------------- filter audit

def plain_audit(docs, labels):
    """{(part, order, step): counts}, document by document."""
    good = Counter()
    toxic = Counter()
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        copy = i is not None and any(o is not None and o < i and (x or "") == t for o, x, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": copy}
        rows.append((lang or "", {f for f in fails if fails[f]}, good[i] if i is not None else 0,
                     toxic[i] if i is not None else 0))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = len([r for r in mine if f in r[1]]) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), before, sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_plain_loops(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(90):
        n = int(rng.integers(1, 320))
        words = rng.choice(vocabulary[:int(rng.choice([5, 60, 400]))], n).tolist()
        text = " ".join(words) + ("#" if i % 4 == 0 else "")
        docs.append((i, text.upper() if i % 5 == 0 else text, ["en", "de", None, ""][i % 4]))
    docs += [(100 + i, docs[3][1], "en") for i in range(40)]                 # a hot text
    docs += [(3, docs[3][1], "de"), (None, docs[3][1], "en"), (None, None, None), (500, "", "fr"),
             (501, None, "fr"), (499, " \t \x1c", "fr"), (502, "É" * 10 + "A", "fr")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (900, 1, 1), (None, 1, 1), (7, None, 1)]
    got = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("x"))
        .withColumn("part", F.lit("clash")).repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert [r[c] for c in filter_audit.COUNTS] == want[r["part"], r["filter_order"], r["step"]], r


def test_filter_audit_edges(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = edge.withColumnRenamed("source", "src")
    assert filter_audit.audit(empty, labels).count() == 0
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 * edge.select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert {r["good_lost"] for r in rows} == {0}
