"""Operator 1: byte-level BPE encoding and decoding.

Each match of the split pattern is a pre-token.  Tier one resolves a
pre-token that is itself in the vocabulary through a minimal perfect hash
(hash and displace: one 64-bit hash, one displacement, one compare); tier
two merges the others with a heap of (rank, position) over a doubly linked
list of their bytes, lowest rank first and leftmost among equals; a table of
all pairs of tokens that make a token gives each pair's rank.  Results of
both tiers are kept per worker in a cache of at most CACHE_BYTES: when half
of it is new, the older half goes, so frequent ones stay.  Pre-tokens of more
than CACHED_CHARS characters (unbroken runs, which hardly repeat) are never
kept, so memory is bounded whatever the text.

The vocabulary (well under 1 MB) is read once on the driver and broadcast.
Encoding and decoding are map-only: no shuffle, one pass over the text.

Defined results: a null text is the empty text and gives an empty list; ids
outside the vocabulary raise ValueError when decoding; a null id list
decodes to empty bytes.  A very long text is worked off as one value, in time
n log n of its longest unbroken run.  Repeated rows give a row each, an empty
table none; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factorcast.llm.common import pieces

CACHE_BYTES = 128 << 20    # of a worker's cache, by estimate
CACHED_CHARS = 64


def read_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by id from a rank file (one base64 token and rank a line)."""
    pairs = (line.split() for line in raw.splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, no misses.

    Keys are dealt to buckets by their hash; from the largest bucket down,
    each bucket gets the first displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], keys_per_bucket: int = 3):
        self.n = len(keys)
        self.buckets = max(1, self.n // keys_per_bucket)
        dealt: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            dealt[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        for bucket in sorted(dealt, key=len, reverse=True):
            if not bucket:
                break
            d = 0
            while True:
                spots = {self._spot(hashes[i], d) for i in bucket}
                if len(spots) == len(bucket) and all(self.slots[s] < 0 for s in spots):
                    break
                d += 1
            self.shift[hashes[bucket[0]] % self.buckets] = d
            for i in bucket:
                self.slots[self._spot(hashes[i], d)] = i
        self.keys = keys

    def _spot(self, h: int, d: int) -> int:
        return ((h >> 20) + d * ((h >> 7) | 1)) % 0x1FFFFFFFFFFFFFFF % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        i = self.slots[self._spot(h, self.shift[h % self.buckets])]
        return i if self.keys[i] == key else -1


class Encoder(dict):
    """Pre-token -> tuple of ids; a missing one is worked out and kept."""

    def __init__(self, tokens: list[bytes], pattern: str, cache_bytes: int | None = None):
        super().__init__()
        self.cache_bytes = CACHE_BYTES if cache_bytes is None else cache_bytes
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = [rank[bytes([i])] for i in range(256)]
        # left token -> right token -> the token they make
        none: dict[int, int] = {}
        self.pair = [none] * len(tokens)
        for t, r in rank.items():
            for i in range(1, len(t)):
                left, right = rank.get(t[:i]), rank.get(t[i:])
                if left is not None and right is not None:
                    if self.pair[left] is none:
                        self.pair[left] = {}
                    self.pair[left][right] = r
        self.split = regex.compile(pattern).findall
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            raw = word.encode("utf-8")
            i = self.whole.get(raw)
            ids = (i,) if i >= 0 else self.merge(raw)
        if len(word) <= CACHED_CHARS:
            # text, tuple, and their places in the dictionary
            self.held += 200 + 4 * len(word) + 8 * len(ids)
            if 2 * self.held > self.cache_bytes:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        pair, byte, n = self.pair, self.byte, len(raw)
        part = [byte[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank and position in one number, so that the least is the next merge
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = []
        for i in range(n - 1):
            if (r := pair[part[i]].get(part[i + 1])) is not None:
                heap.append(r << bits | i)
        heapify(heap)
        while heap:
            top = heap[0]
            i = top & low
            both, left, j = top >> bits, part[i], after[i]
            # gone, or one of the two has grown since
            if left < 0 or j >= n or pair[left].get(part[j]) != both:
                heappop(heap)
                continue
            part[i], part[j] = both, -1
            k, h = after[j], before[i]
            after[i] = k
            first = second = None
            if k < n:
                before[k] = i
                first = pair[both].get(part[k])
            if h >= 0:
                second = pair[part[h]].get(both)
            if first is not None:
                heapreplace(heap, first << bits | i)
                if second is not None:
                    heappush(heap, second << bits | h)
            elif second is not None:
                heapreplace(heap, second << bits | h)
            else:
                heappop(heap)
        return tuple([p for p in part if p >= 0])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


_ENCODERS: dict[tuple[str, str, int | None], Encoder] = {}


def _encoder(raw: bytes, pattern: str, cache_bytes: int | None = None) -> Encoder:
    key = (xxhash.xxh3_64_hexdigest(raw), pattern, cache_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(raw), pattern, cache_bytes)
    return _ENCODERS[key]


def _lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _encoded(enc: Encoder, texts: pa.Array) -> list[list[int]]:
    return [enc.encode(value.as_py() or "") for value in texts]


def _decoded(tokens: list[bytes], ids: list[int]) -> bytes:
    if ids and (min(ids) < 0 or max(ids) >= len(tokens)):
        raise ValueError("token id outside the vocabulary")
    return b"".join(map(tokens.__getitem__, ids))


def _shipped(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column | str, ranks_path: str, pattern: str) -> Column:
    """Column of token ids (array<int>) of the text column."""
    shipped = _shipped(spark, ranks_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(shipped.value, pattern)
        for batch in pieces(batches):
            yield _lists(_encoded(enc, batch))

    return ids(text)


def decode(spark: SparkSession, ids: Column | str, ranks_path: str) -> Column:
    """Column of the bytes (binary) that a column of token ids stands for."""
    shipped = _shipped(spark, ranks_path)

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = read_ranks(shipped.value)
        for batch in pieces(batches):
            yield pa.array([_decoded(tokens, v.as_py() or []) for v in batch], pa.binary())

    return raw(ids)


def encode_decode(spark: SparkSession, text: Column | str, ranks_path: str,
                  pattern: str, cache_bytes: int | None = None, rows: int = 1000) -> Column:
    """Column struct<ids, decoded>: each text's ids, and the bytes that these
    ids decode to; both in one worker, so that ids do not travel twice.  A
    worker keeps ``cache_bytes`` (CACHE_BYTES) of pre-tokens and the lists of ``rows`` texts."""
    shipped = _shipped(spark, ranks_path)

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(shipped.value, pattern, cache_bytes)
        for batch in pieces(batches, rows):
            lists = _encoded(enc, batch)
            raw = pa.array([_decoded(enc.tokens, x) for x in lists], pa.binary())
            yield pa.StructArray.from_arrays([_lists(lists), raw], ["ids", "decoded"])

    return both(text)


def round_trip(docs, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text"):
    """(id, ids, decoded): every text encoded, and its ids decoded again."""
    coded = docs.select(F.col(id_col).alias("_id"), encode_decode(
        docs.sparkSession, F.col(text_col), ranks_path, pattern).alias("_both"))
    return coded.select(F.col("_id").alias(id_col), "_both.ids", "_both.decoded")
