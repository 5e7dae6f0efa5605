"""SimHash and embedding links against brute force; components against union-find."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorcast.llm import itq, queries, simhash
from factorcast.llm.common import components, lookup, prefix_sums


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+",
                       re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_components(prints):
    """prints: list of (id, fingerprint)"""
    links = [(i, j) for i in range(len(prints)) for j in range(i)
             if (prints[i][1] ^ prints[j][1]).bit_count() <= 4]
    group = union_find(range(len(prints)), links)
    least = {}
    for n, (ident, _) in enumerate(prints):
        if ident is not None:
            least[group[n]] = min(ident, least.get(group[n], ident))
    return [(ident, f"{p:016x}", least.get(group[n])) for n, (ident, p) in enumerate(prints)]


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_simhash_query_equals_brute_force(spark, docs, segments):
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()])
    got = simhash.near_duplicates(docs, segments=segments)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(want)


def test_simhash_edges(spark, edge, edge_rows, empty):
    want = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in edge_rows])
    got = simhash.near_duplicates(edge).collect()
    assert sorted(map(str, [(r[0], r[1], r[2]) for r in got])) == sorted(map(str, want))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and None in ids
    assert simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_candidates_are_exact(spark, segments):
    random.seed(3)
    seeds = [random.getrandbits(64) for _ in range(30)]
    codes = set(seeds)
    for s in seeds:
        for _ in range(12):
            c = s
            for b in random.sample(range(64), random.randint(1, 6)):
                c ^= 1 << b
            codes.add(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    got = simhash.candidates(df, "code", "code", segments, 4 // segments, 4).collect()
    want = {(a, b) for a in signed for b in signed
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    random.seed(5)
    n = 40
    order = random.sample(range(n), n)
    links = {"path": list(zip(order, order[1:])), "star": [(order[0], o) for o in order[1:]],
             "random": [(random.randrange(n), random.randrange(n)) for _ in range(25)],
             "none": []}[shape]
    got = components(spark.createDataFrame(links or [(0, 0)], "a long, b long")).collect()
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert {r["node"]: r["component"] for r in got} == union_find(
        nodes, [(a, b) for a, b in links if a != b]) and len(got) == len(nodes)


def test_lookup_spreads_hot_keys_and_keeps_rows(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 1 "
                                        "then null else concat('k', id) end as key")
    keyed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = lookup(rows, keyed, "key", "id", "n", 5000).collect()
    assert len(got) == 5000
    assert all(r["least"] == (None if r["key"] is None else 0 if r["key"] == "hot" else r["id"])
               for r in got)


def test_prefix_sums(spark):
    rows = spark.range(1000).selectExpr("id", "id % 5 as g", "pmod(id * 7919, 13) as v")
    got = prefix_sums(rows, ["g", "id"], "v", "before").collect()
    run, want = 0, {}
    for r in sorted(got, key=lambda r: (r["g"], r["id"])):
        want[r["id"]] = run
        run += r["v"]
    assert {r["id"]: r["before"] for r in got} == want


def vectors(n=400, d=32, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    for i in range(0, n, 4):
        v[i + 1] = v[i] + 0.25 * rng.standard_normal(d)
        v[i + 2] = v[i]
    return [(i, [float(x) for x in r]) for i, r in enumerate(v)]


def test_itq_recall_and_links(spark):
    rows = vectors()
    m = np.array([r for _, r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i != j}
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    links = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert sum(links.values()) >= 0.9 * len(want)
    for i, n in links.items():
        assert n <= sum(1 for a, _ in want if a == i)


def test_itq_edges(spark):
    bad = [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31),
           (903, [float("inf")] + [1.0] * 31), (904, [None] + [1.0] * 31), (905, [1.0, 2.0]),
           (906, [2.0, 4.0]), (None, [1.0] * 32), (907, [1.0] * 32), (907, [1.0] * 32)]
    df = spark.createDataFrame(vectors() + bad, "vec_id long, embedding array<double>")
    rows = {}
    for r in itq.near_vectors(df.withColumn("a", F.lit(1)).withColumn("_v", F.lit(2))).collect():
        rows.setdefault(r["vec_id"], []).append(r)
    for i in range(900, 905):
        assert rows[i][0]["n_links"] == 0 and rows[i][0]["kept"]
    assert rows[905][0]["n_links"] == rows[906][0]["n_links"] == 1
    assert [r["n_links"] for r in rows[907]] == [2, 2] and rows[None][0]["component_id"] == 907
    assert itq.near_vectors(df.where("false")).count() == 0
    assert itq.near_vectors(df.where("vec_id = 900")).count() == 1


@pytest.mark.parametrize("dims", [16, 64, 96])
def test_recall_exactly_at_the_threshold(spark, dims):
    """Pairs planted at a cosine of 0.9 (and a trifle) are found at a rate of 0.9 or more."""
    rng = np.random.default_rng(dims)
    m = rng.standard_normal((900, dims))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    side = rng.standard_normal(u.shape)
    side -= (side * u).sum(axis=1, keepdims=True) * u
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.9 + 1e-9
    both = np.r_[u, cos * u + np.sqrt(1 - cos * cos) * side]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(both)],
                               "vec_id long, embedding array<double>")
    got = itq.near_vectors(df).agg(F.sum("n_links")).first()[0]
    want = int((both @ both.T >= 0.9).sum()) - len(both)
    assert want >= 1800 and 0.9 * want <= got <= want


def test_tables_keep_chance_candidates_bounded():
    """Random vectors meet at most some (width + 1) / 16 others a table, whatever their number."""
    for n in (1, 100, 10 ** 4, 10 ** 6, 10 ** 8, 10 ** 10):
        tables, width = itq.plan_tables(n, 0.9, 0.95, 1)
        assert n * (width + 1) / 2 ** width <= (width + 1) / 16
        assert width < itq.TABLE_BIT and tables < 1 << (62 - itq.TABLE_BIT)
    assert itq.plan_tables(100, 1.0, 0.95, 0) == (1, 16)
    assert itq.plan_tables(10 ** 8, 0.9, 0.95, 1)[0] < 8 * itq.plan_tables(10 ** 4, 0.9, 0.95, 1)[0]


def test_retrieved_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    codes = [[rng.getrandbits(8) + (t << itq.TABLE_BIT) for t in range(3)] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(codes)), "_class long, _cells array<long>")
    for radius in (0, 1, 2):
        got = [(r["a"], r["b"]) for r in itq.retrieve(df, 8, radius).collect()]
        assert sorted(got) == [(i, j) for i in range(120) for j in range(i + 1, 120) if any(
            (x ^ y).bit_count() <= radius for x, y in zip(codes[i], codes[j]))]


def test_query_recall_on_table(spark):
    """Recall on the given table against brute force, at least 0.9."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r["embedding"] for r in rows], float)
    # near copies of a tenth of the vectors, at cosines around 0.93
    rng = np.random.default_rng(1)
    near = m[::10] + 0.05 * rng.standard_normal(m[::10].shape) * np.linalg.norm(m[::10], axis=1)[:, None]
    both = np.r_[m, near]
    u = both / np.linalg.norm(both, axis=1, keepdims=True)
    want = int((u @ u.T >= 0.9).sum()) - len(u)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(both)],
                               "vec_id long, embedding array<double>")
    got = itq.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert want > 100 and 0.9 * want <= got <= want
    assert queries.op6_itq(spark, sf).count() == len(rows)


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id, rows without one, and copies of either: one row a
    component, that of the smallest id (null last), then of the least text hash."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    a, b, c = (" ".join(words[i:i + 100]) for i in (0, 120, 240))
    near = b + " " + words[130]
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c + " x"), (None, a), (9, c), (5, near), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("clash"))
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(df, max_bits=12).collect())
    assert kept == sorted([(5, a), (3, b), (9, c)])
    alone = spark.createDataFrame([(None, c), (None, c + " x"), (None, c)], "doc_id long, text string")
    assert simhash.deduplicate(alone, max_bits=12).count() == 1


def test_rows_of_hot_keys_are_dealt_by_more_than_the_key(spark):
    keyed = spark.createDataFrame([(i, i * 10, 900 if i == 0 else 1) for i in range(100)],
                                  "k long, v long, n long")
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id") - 900)
                                    .cast("long").alias("k"), F.col("id").alias("u"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup(rows, keyed, "k", "u", "n", 999)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("_spread") > 2 and "hashpartitioning(k" in plan
    assert not any("hashpartitioning(k" in line and "_spread" not in line for line in plan.splitlines())
