"""Archives, toxicity, fingerprints, mixing, language, sharding and the pipeline."""
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorcast.llm import (langid, mixing, order_minhash, queries, sharding, simhash, toxicity,
                            warc)
from factorcast.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


# archives
def page_rows():
    return [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None),
            (4, "http://b", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (6, "ü", "漢" * 4000),
            (7, "http://c", "z" * 300_000), (None, "http://n", "<p>one</p>"),
            (8, "http://d", "only null id twin"), (8, "http://d", "only null id twin")]


def test_arc_to_warc_round_trip(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn(
        "block", F.lit("clash")).withColumn("uri", F.lit(1)).repartition(2)
    got = warc.convert(df).collect()
    best = {}
    for i, _, h in page_rows():
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = []
    for i, _, h in page_rows():
        raw = (h or "").encode()
        again = i != best.get(h or "", i)
        want.append((str(i), len(raw), warc.sha1_base32(raw),
                     "revisit" if again else "response", best[h or ""] if again else None))
    assert sorted(map(str, want)) == sorted(str((
        str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
        r["refers_to"])) for r in got)


def test_min_bytes_and_blocks(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    path = f"{ensure_checkpoint_dir(spark)}/warc-test"
    records = warc.arc_records(warc.to_arc(df))
    warc.write_warc(records, path, min_bytes=1000)
    rows = warc.read_warc(spark, path).collect()
    assert {r["record_type"] for r in rows} == {"response"}
    blocks = {r["page_id"]: bytes(r["block"]) for r in rows}
    assert blocks[6].endswith(("漢" * 4000).encode()) and blocks[6].startswith(b"HTTP/1.1 200")


def test_arc_versions_dates_and_errors():
    one = (b"filedesc://x 0.0.0.0 1996 text/plain 75\n1 0 org\nURL IP-address Archive-date "
           b"Content-type Archive-length\n\n")
    body = one.split(b"\n", 1)[1]
    head = b"filedesc://x 0.0.0.0 1996 text/plain %d\n" % len(body)
    record = b"http://h/ 1.2.3.4 199609 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\n"
    rows = list(warc.parse_arc(head + body + b"\n" + record))
    assert rows[0][3] == "1996-09-01T00:00:00Z" and rows[0][7] == 5
    assert rows[0][8] == warc.sha1_base32(b"hello") and rows[0][5] == "response"
    assert list(warc.parse_arc(b"")) == []
    with pytest.raises(ValueError, match="declared length"):
        list(warc.parse_arc(head + body + record[:-10]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(record))
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc(head + body + b"http://h/ 1 2\n"))
    with pytest.raises(ValueError, match="ARC date"):
        warc.iso_date("96")


def test_revisits_name_a_record_of_the_archive(spark):
    """Target URLs stay as given, each record has its own identifier, and a
    revisit's record identifier, URL and date are those of its response."""
    url = "https://h.example/en/7?a=b#top"
    df = spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (4, url, "<p>one</p>"),
                                (4, url, "<p>one</p>"), (2, None, "<p>one</p>"),
                                (None, "http://n", "<p>one</p>"), (9, "http://z", "other")],
                               "page_id long, url string, html string")
    rows = warc.convert(df).collect()
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(rows) == 6
    assert sorted(r["uri"] for r in rows) == sorted(
        ["http://a/", url, url, "urn:page:2", "http://n", "http://z"])
    again = [r for r in rows if r["record_type"] == "revisit"]
    assert sorted(str(r["page_id"]) for r in again) == ["1", "2", "None"]
    for r in again:
        response = by_id[r["refers_to_id"]]
        assert response["record_type"] == "response" and response["page_id"] == r["refers_to"] == 4
        assert (response["uri"], response["warc_date"]) == (r["refers_to_uri"], r["refers_to_date"])
        assert response["payload_digest"] == r["payload_digest"]


def test_one_gzip_member_a_record(spark, monkeypatch):
    """Every record is a gzip member of its own; files close after FILE_CHUNKS pieces."""
    monkeypatch.setattr(warc, "FILE_CHUNKS", 1)
    rng = random.Random(3)
    html = ["".join(rng.choices("abcdefghijklmnop", k=3_000_000)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(["", "x", "<p>é</p>", *html])),
                               "page_id long, html string").withColumn(
        "url", F.lit("http://h/")).coalesce(1)
    path = f"{ensure_checkpoint_dir(spark)}/warc-members"
    rows = warc.convert(df, path).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(9))
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) > 1
    records = []
    for data in files:
        while data:
            member = zlib.decompressobj(31)
            text = member.decompress(bytes(data)) + member.flush()
            data = member.unused_data
            if text:
                records += list(warc.parse_warc(text))
                assert text.count(b"WARC-Record-ID: ") == 1
    assert sorted(r[0] for r in records) == list(range(9))


def test_arc_files_to_warc(spark, tmp_path):
    """Foreign ARC files, gzipped and plain, of both versions, read from a folder."""
    one = "1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n"
    two = ("2 0 org\nURL IP-address Archive-date Content-type Result-code Checksum Location "
           "Offset Filename Archive-length\n\n")
    page = "HTTP/1.0 200 OK\r\n\r\nhello"
    first = (f"filedesc://a.arc 0.0.0.0 1996 text/plain {len(one)}\n{one}\n"
             f"http://h/ 1.2.3.4 19960923142103 text/html {len(page)}\n{page}\n"
             "dns:h 1.2.3.4 1996 text/dns 4\nh A1\n")
    second = (f"filedesc://b.arc 0.0.0.0 1999 text/plain 200 - - 0 b.arc {len(two)}\n{two}\n"
              f"http://i/ 5.6.7.8 199912 text/html 200 - - 0 b.arc {len(page)}\n{page}\n")
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(first.encode()))
    (tmp_path / "b.arc").write_bytes(second.encode())
    found = {r["uri"]: r for r in warc.read_arc(spark, str(tmp_path)).collect()}
    assert {u: (r["warc_type"], r["warc_date"], r["page_id"]) for u, r in found.items()} == {
        "http://h/": ("response", "1996-09-23T14:21:03Z", None),
        "dns:h": ("resource", "1996-01-01T00:00:00Z", None),
        "http://i/": ("response", "1999-12-01T00:00:00Z", None)}
    path = f"{ensure_checkpoint_dir(spark)}/warc-foreign"
    warc.convert_arcs(spark.read.format("binaryFile").load(str(tmp_path)), path, "content")
    back = {r["uri"]: r for r in warc.read_warc(spark, path).collect()}
    assert {u: bytes(r["block"]) for u, r in back.items()} == {
        "http://h/": page.encode(), "dns:h": b"h A1", "http://i/": page[:-5].encode()}
    assert back["http://i/"]["record_type"] == "revisit"
    assert back["http://i/"]["refers_to_uri"] == "http://h/"
    assert {u: r["record_id"] for u, r in back.items()} == {
        u: r["record_id"] for u, r in found.items()}


# toxicity
def test_levenshtein_walk_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    random.seed(2)
    terms = ["idiot", "moron", "disgusting", "abc", "pathetic", "scum"]
    lexicon = toxicity.Lexicon(terms, [])
    words = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(random.randint(1, 3)):
                i = random.randrange(len(w) + 1)
                w[i:i + random.randint(0, 1)] = random.choice(["", "a", "i", "t"])
            words.add("".join(w))
    for w in words - {""}:
        near = {distance(w, t) for t in terms if distance(w, t) <= min(
            toxicity.errors_allowed(len(t)), toxicity.errors_allowed(len(w) + 1))}
        want = 1 if 0 in near else 2 if near else 0
        assert lexicon.match(w) == want, w
    assert toxicity.Lexicon([], ["lowe"]).match("loweisch") == 1


def test_misspelled_words_of_a_stem():
    lexicon = toxicity.choose([("idio*", 100.0), ("idiot", 60.0), ("idiots", 40.0),
                               ("idioti*", 30.0), ("moron", 20.0), ("moro*", 20.0)])
    assert lexicon.stems == ["idio"] and lexicon.words == ["idiot", "idiots", "moron"]
    assert [lexicon.match(w) for w in ("idiot", "idiotically", "idjot", "idjots", "idot")] == [
        1, 1, 2, 2, 2]


def test_quotation_is_a_mention():
    lexicon = toxicity.Lexicon(["idiot"], [], ["schrieb"])
    assert lexicon.features("you idiot")[0] > 0
    assert lexicon.features('they wrote "what an idiot" there')[:3] == [0, 0, np.log1p(1)]
    assert lexicon.features("")[-1] == 1.0
    mentions = ["er rief „du idiot“ und ging", "elle dit « quel idiot » hier", "so »idiot« eben",
                "the word ‘idiot’ here", "he's heard “idiot” twice", 'a 5" nail, "idiot" it read',
                "sie schrieb ihm idiot", "‚idiot‘ steht da", "schrieb: idiot"]
    direct = ["you’re an idiot and you’re a fool", "l’homme est un idiot et n’a rien",
              'a 5" nail you idiot, 6" next', "it's an idiot, isn't it", "“open idiot",
              '"one"\nidiot\n"two"', "schrieb\nidiot", "« a » idiot « b »", "idiot schrieb",
              "er schrieb ihr gestern abend noch idiot", '"' + "x" * 20 + " idiot " + "y" * 90 + '"']
    for text in mentions:
        assert lexicon.features(text)[:4] == [0, 0, np.log1p(1), 0], text
    for text in direct:
        assert lexicon.features(text)[:4] == [np.log1p(1), 0, 0, 0], text


def plain_features(lexicon, text):
    """Features by comparing each word with each term, and each mark in turn."""
    low = text.lower()
    spans = []
    for line_at, line in zip(np.cumsum([0] + [len(x) + 1 for x in low.split("\n")]).tolist(),
                             low.split("\n")):
        opened = None
        for i, c in enumerate(line):
            p, n = line[i - 1:i], line[i + 1:i + 2]
            if c not in "\"“”„«»‘’‚" or p.isalnum() and n.isalpha():
                continue
            if opened is not None and c in toxicity.CLOSED_BY[line[opened]]:
                spans.append((line_at + opened, line_at + i))
                opened = None
            elif opened is None and c in toxicity.CLOSED_BY and not p.isalnum() and (c == "«" or n.strip()):
                opened = i
    count, places = [0, 0, 0, 0], []
    for m in re.finditer(r"[^\W\d_]+", low):
        kind = lexicon.match(m.group())
        if not kind:
            continue
        line = low.rfind("\n", 0, m.start()) + 1
        near = re.findall(r"[^\W\d_]+", low[max(line, m.start() - 80):m.start()])[-3:]
        mention = any(a < m.start() and m.end() <= b <= m.end() + 80 for a, b in spans) or any(
            w in lexicon.reporting for w in near)
        count[kind - 1 + 2 * mention] += 1
        places.append(m.start())
    dense = max([sum(q <= p and q >= p - 80 for q in places) - 1 for p in places], default=0)
    return [math.log1p(c) for c in count] + [math.log1p(dense), 1.0]


def test_features_equal_a_plain_scorer():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon(["idiot", "pathetic"], ["scum"], ["said", "dit", "nannte"])
    bits = ["idiot", "idjot", "pathetic", "scummy", "said", "dit", "nannte", "the", "x’a", "l’homme", " ",
            " ", " ", "\n", '"', "“", "”", "„", "«", "»", "‘", "’", "‚", "5", ",", "word " * 20]
    for _ in range(800):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert lexicon.features(text) == pytest.approx(plain_features(lexicon, text)), text


def test_reporting_words_are_learned(spark):
    """Words before hits in clean texts, whatever the language."""
    rows = [(0, f"n{i} elle nomma idiot {i}") for i in range(40)] + [(1, f"{i} toi sale idiot") for i in range(40)]
    rows += [(0, f"{i} plain text") for i in range(40)] + [(0, "once rare idiot")]
    df = spark.createDataFrame(rows, "toxic int, text string")
    got = toxicity.reporting_words(df, toxicity.Lexicon(["idiot"], []))
    assert "nomma" in got and "elle" in got and not {"toi", "sale", "rare", "plain"} & set(got)
    assert toxicity.reporting_words(df.where("toxic = 1"), toxicity.Lexicon(["idiot"], [])) == []


def test_more_terms_than_any_cap():
    rows = [(f"word{i:05d}", 30.0 + i) for i in range(5000)]
    assert len(toxicity.choose(rows).words) == 5000


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, SF1).collect()}
    labels = spark.read.parquet(f"{SF1}/labels.parquet").collect()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels
            if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    assert held and all(s["held_out"] for _, s in held)
    assert sum(t == s["predicted"] for t, s in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rare_terms_with_evidence_are_learned(spark):
    """15 of 1,600 toxic families, no clean one: under 1 %, G squared about 33."""
    rows = [(i, f"{i}x {i}y {i}z " + (
        "filler" if i >= 1600 else "gilipollas" if i < 15 else "scumbag")) for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1600).cast("int").alias("toxic"))
    lexicon, _ = toxicity.train(docs, labels)
    assert lexicon.match("gilipollas") == 1 and lexicon.match("gilipolas") == 2
    assert lexicon.match("scumbag") == 1 and lexicon.match("filler") == 0


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for docs in (edge, empty):
        for marks in (labels, labels.where("false")):
            model = toxicity.train(docs, marks)
            scores = docs.select(toxicity.score(spark, F.col("text"), model).alias("s")).collect()
            assert len(scores) == docs.count() and all(0 <= r["s"] <= 1 for r in scores)


# fingerprints
def plain_order_minhash(spark, text, k=2, bins=64, length=2):
    """The same signatures from plain loops; Spark's hash is asked for the numbers."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    starts = range(max(1, len(words) - k + 1)) if words else []
    grams = [words[i:i + k] + [None] * (k - len(words[i:i + k])) for i in starts]
    if not grams:
        return [None] * bins
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(grams)], "i int, a string, b string")
    hashes = {r["i"]: r["h"] >> order_minhash.POS_BITS for r in df.selectExpr("i", "xxhash64(a, b) h").collect()}
    seen, rows = Counter(), []
    for i in starts:
        rows.append((i, hashes[i], seen[hashes[i]]))
        seen[hashes[i]] += 1
    df = spark.createDataFrame(rows, "i int, h long, n int").selectExpr("i", "h", "xxhash64(h, n) o")
    by_bin = defaultdict(list)
    for r in df.collect():
        by_bin[(r["o"] & (1 << 64) - 1) >> 58].append((r["o"] >> order_minhash.POS_BITS, r["i"], r["h"]))
    out = []
    for b in range(bins):
        least = sorted(by_bin[b])[:length]
        out.append(tuple(h for _, _, h in sorted(least, key=lambda x: x[1])) or None)
    return out


def test_order_minhash_equals_loops(spark):
    random.seed(4)
    texts = ["", None, "one", "a b a b a b a b a b", " ".join(random.choices("abcde", k=300)),
             " ".join(str(i) for i in range(200)), " ".join(str(i) for i in reversed(range(200)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["f"] for r in order_minhash.with_fingerprints(df, {"t": "f"}).collect()}
    for t in texts:
        want = plain_order_minhash(spark, t)
        parts = [got[t][i:i + 4] for i in range(0, 256, 4)]
        assert [p == "...." for p in parts] == [w is None for w in want]
        tuples = [" ".join(map(str, w)) for w in want if w]
        if tuples:
            hashed = spark.createDataFrame([(i, x) for i, x in enumerate(tuples)], "i int, x string")
            heads = [r[0] for r in hashed.orderBy("i").selectExpr(
                "lower(substring(lpad(hex(xxhash64(x)), 16, '0'), 1, 4))").collect()]
            assert [p for p in parts if p != "...."] == heads


def test_swapped_halves_at_all_sizes(spark):
    """Mean likeness of a text to itself with swapped halves is that of 64 independent hashes."""
    def independent(words, seed):
        seen, rows = Counter(), []
        for i, g in enumerate(zip(words, words[1:])):
            h = hashlib.blake2b(f"{seed} {g} {seen[g]}".encode(), digest_size=8).digest()
            rows.append((h, i, g))
            seen[g] += 1
        return [g for _, _, g in sorted(sorted(rows)[:2], key=lambda r: r[1])]

    rng = random.Random(8)
    rows, want = [], defaultdict(list)
    for n in (20, 40, 80, 160, 400):
        for _ in range(60):
            words = [str(rng.randrange(10_000)) for _ in range(n)]
            swapped = words[n // 2:] + words[:n // 2]
            rows.append((n, " ".join(words), " ".join(swapped)))
            if len(want[n]) < 20:
                want[n].append(np.mean([independent(words, s) == independent(swapped, s)
                                        for s in range(64)]))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    got = {r["n"]: r["l"] for r in order_minhash.with_fingerprints(
        df, {"a": "fa", "b": "fb"}, dense=True).select("n", order_minhash.likeness(
            F.col("fa"), F.col("fb")).alias("l")).groupBy("n").agg(F.avg("l").alias("l")).collect()}
    for n, parts in want.items():
        assert abs(got[n] - np.mean(parts)) < 0.06, (n, got[n], np.mean(parts))
    short = spark.createDataFrame([(1, "a b c d e"), (2, "one"), (3, "")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"]
              for r in order_minhash.edited_fingerprints(short).collect()}
    assert "...." not in prints[1] + prints[2] and prints[3] == "...." * 64


def test_positions_of_the_longest_text_fit(spark):
    """A value has fewer than 2^31 bytes, so at most 2^30 words; hash and place
    come back from one number, whatever the sign of the hash."""
    rows = [(h, p) for h in (-(1 << 63), -1, 0, 12345678901234567, (1 << 63) - 1)
            for p in (0, 1, (1 << 24) - 1, 1 << 24, (1 << 30) - 1)]
    packed = order_minhash._packed(F.col("h"), F.col("p"))
    got = spark.createDataFrame(rows, "h long, p int").select(
        "h", "p", order_minhash._pos_of(packed).alias("q"), order_minhash._hash_of(packed).alias("g")).collect()
    assert all(r["q"] == r["p"] and r["g"] == r["h"] >> order_minhash.POS_BITS for r in got)


def test_edited_texts_and_likeness(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in order_minhash.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text)
    by_text = defaultdict(set)
    for i, text in rows:
        by_text[text].add(got[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    mean = lambda c: np.mean([r[c] for r in got.values()])
    assert mean("near_edited") > 2 * mean("near_next")


def test_order_minhash_edges(spark, edge, edge_rows, empty):
    got = order_minhash.edited_fingerprints(edge).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert order_minhash.edited_fingerprints(empty).count() == 0


# mixing
def test_mixing_edges(spark, edge, edge_rows, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(edge_rows)
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"])
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        assert rows[0]["target"] <= 3 * rows[0]["source_size"]
    assert abs(sum(rows[0]["target"] for rows in by.values()) - total) < 1e-6 * max(1, total)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() > 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_follow_the_plan(spark, docs):
    plan = mixing.mix(docs).collect()
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    for r in plan:
        part = 1 if r["part"] and r["part"] * 2 >= r["size"] else 0
        assert copies[r["doc_id"]] == r["epochs"] + part
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in plan}


# language
def test_ppm_code_lengths_equal_loops():
    random.seed(1)
    train = {"x": b"abracadabra abra " * 4, "y": b"hello world hollow " * 4}
    langs = sorted(train)
    grams, codes = Counter(), {}
    for i, name in enumerate(langs):
        t = langid.PAD + train[name]
        for j in range(len(t) - 3):
            grams[i, int.from_bytes(t[j:j + 4], "big")] += 1
    keys = list(grams)
    model = langid.build(langs, np.array([k[0] for k in keys]), np.array([k[1] for k in keys]),
                         np.array([grams[k] for k in keys]), max_contexts=10 ** 6)
    totals = Counter()
    for (_, g), n in grams.items():
        totals[g >> 8] += n

    def bits(i, text):
        t, out = langid.PAD + text, 0.0
        for j in range(3, len(t)):
            p = 1 / 256
            for order in range(4):
                if order == 3 and totals[int.from_bytes(t[j - 3:j], "big")] < 2:
                    continue
                seen = Counter()
                for (lang, g), n in grams.items():
                    raw = g.to_bytes(4, "big")
                    if lang == i and raw[3 - order:3] == t[j - order:j]:
                        seen[raw[3]] += n
                room = sum(seen.values()) + len(seen)
                if seen:
                    p = seen[t[j]] / room if seen[t[j]] else len(seen) / room * p
            out -= np.log2(p)
        return out

    texts = [b"abra", b"hello abra", b"zz\xff", b""]
    got = langid.code_lengths(model, texts)
    for t, row in zip(texts, got):
        for i in range(2):
            assert abs(row[i] - bits(i, t)) < 1e-6 * max(1, len(t))
    long = b"hello world " * 200_000
    assert langid.code_lengths(model, [long, b"abra"])[0].argmin() == 1


def test_language_held_out(spark):
    rows = queries.op9_ppm_language(spark, SF01).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_edges(spark, edge, edge_rows, empty):
    model = langid.train(edge)
    marked, name = langid.with_language(edge, model)
    rows = marked.collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r[name]["lang"] == "und") == (not has_letter) and 0 <= r[name]["score"] <= 1
    assert langid.train(empty) is None
    marked, name = langid.with_language(edge, None)
    assert {r[name]["lang"] for r in marked.collect()} == {"und"}


# sharding
def check_shards(rows, shards, law):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    if law == "rows":
        n = [len(by[s]) for s in range(shards)]
        assert max(n) - min(n) <= 1
    return by


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding(spark, law):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    # one text holds a third of the rows
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "copy").otherwise(F.col("text")))
    rows = sharding.shard(docs, law=law).collect()
    by = check_shards(rows, 16, law)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 16) if law == "key" else r["grown_shard"] is None
    if law == "bytes":
        sizes = [sum(r["size"] for r in by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16 + 2 * max(r["size"] for r in rows)


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding_edges(spark, edge, edge_rows, empty, law):
    rows = sharding.shard(edge, law=law).collect()
    assert len(rows) == len(edge_rows)
    check_shards(rows, 16, law)
    assert sharding.shard(empty, law=law).count() == 0


# pipeline
def test_pipeline_equals_stage_by_stage_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_known_language(spark, docs, SF)
    assert kept.columns == docs.columns
    clean = corpus_pipeline.drop_toxic(spark, kept, SF)
    one = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    groups = simhash.near_duplicates(clean).collect()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in groups})
    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in mixed.collect())
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in out)


def test_pipeline_edges(spark, edge, empty):
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert(df).count() == 0
