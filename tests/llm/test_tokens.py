"""BPE encoding and decoding, and piece counts, against the public libraries."""
import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorcast.llm import bpe, piece_counts, queries

RANKS = P.path(queries.RANKS)
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
ENCODER = bpe.Encoder(bpe.read_ranks(open(RANKS, "rb").read()), P.PATTERN)
COUNTER = piece_counts.PieceCounter(piece_counts.read_pieces(P.path(queries.PIECES)))
TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from(" \n\tabcdeè漢▁'s<>1")), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoder_equals_library(text):
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counter_equals_library(text):
    assert COUNTER.count(text) == len(PIECES.encode(text))


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000))
    assert [h.get(k) for k in keys] == list(range(5000))
    assert h.get(b"none") == -1 and bpe.PerfectHash([]).get(b"x") == -1


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    own = bpe.Encoder(ENCODER.tokens, P.PATTERN)
    random.seed(0)
    text = " ".join("".join(random.choices("abcdef", k=7)) for _ in range(200))
    assert own.encode(text) == LIBRARY.encode_ordinary(text)
    assert sum(200 + 4 * len(w) + 8 * len(i) for w, i in (own | own.older).items()) <= 5000


def test_unbroken_runs_are_not_kept():
    """Whatever the text, a worker keeps short pre-tokens only."""
    own = bpe.Encoder(ENCODER.tokens, P.PATTERN)
    counter = piece_counts.PieceCounter([(p, s) for p, s in COUNTER.score.items()])
    random.seed(1)
    for n in (63, 64, 65, 5000, 100_000):
        run = "".join(random.choices("abcdefghij", k=n))
        assert own.encode(run) == LIBRARY.encode_ordinary(run)
        assert counter.count(run) == len(PIECES.encode(run))
    for cache in (own, counter):
        assert cache and max(map(len, cache)) <= 65          # one space mark more


def test_single_tokens_are_proved():
    assert all(len(PIECES.encode(p.replace("▁", " ")[1:])) == 1
               for p in COUNTER.single if p.startswith("▁") and "▁" not in p[1:] and len(p) > 1)
    with pytest.raises(ValueError):
        piece_counts.PieceCounter([("a▁b", 0.0)])


def test_operators_on_edges(spark, edge, edge_rows, empty):
    got = bpe.round_trip(edge, RANKS, P.PATTERN).collect()
    want = sorted((str(i), LIBRARY.encode_ordinary(t or ""), (t or "").encode())
                  for i, t, *_ in edge_rows)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want
    counts = edge.select("doc_id", piece_counts.n_tokens(
        spark, F.col("text"), P.path(queries.PIECES)).alias("c")).collect()
    assert sorted((str(r[0]), r[1]) for r in counts) == sorted(
        (str(i), len(PIECES.encode(t or ""))) for i, t, *_ in edge_rows)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_unknown_id_is_an_error(spark):
    df = spark.sql("select array(1, 60000) as ids")
    with pytest.raises(Exception, match="token id outside the vocabulary"):
        df.select(bpe.decode(spark, "ids", RANKS)).collect()
    assert bytes(spark.sql("select cast(null as array<int>) as ids").select(
        bpe.decode(spark, "ids", RANKS).alias("d")).first()["d"]) == b""


def test_queries_equal_library(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for r in queries.op7_piece_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(PIECES.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_encoder_keeps_no_more_than_its_cache():
    import public_tokenizers
    from factorcast.llm import bpe
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tokens = bpe.read_ranks(f.read())
    small = bpe.Encoder(tokens, public_tokenizers.PATTERN, cache_bytes=20_000)
    text = " ".join(f"word{i}" for i in range(5_000))
    assert small.encode(text) == bpe.Encoder(tokens, public_tokenizers.PATTERN).encode(text)
    assert len(small) + len(small.older) <= 20_000 // 200
