"""Operator 7: token counts with a whole-token shortcut.

For a piece vocabulary (BPE with byte fallback, white space written as
U+2581) two facts are proved offline, on the vocabulary alone:

* no piece holds a space mark after another character, nor a character of
  the set ``breaks`` beside any other, so merges never cross a pre-token
  (space marks plus what follows up to the next mark or break);
* which vocabulary strings, merged alone, end as one token.

Pre-tokens that are such strings count as one each, directly; the rest are
merged (best score first, leftmost among equals) and a character that no
piece has counts its UTF-8 bytes.  Counts are kept per worker in a cache of
CACHE_ENTRIES pre-tokens of at most CACHED_CHARS characters, so its memory is
bounded whatever the text.  Map-only: no shuffle, one pass over the text.

Defined results: a null text is the empty text and has no tokens.  A very long
text is worked off as one value, in time n log n of its longest unbroken run.
Repeated rows count each, an empty table gives no rows; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factorcast.llm.common import pieces

CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
SPACE = "▁"


class PieceCounter(dict):
    """Pre-token -> number of tokens; a missing one is merged and kept."""

    def __init__(self, scored: list[tuple[str, float]]):
        super().__init__()
        self.score = dict(scored)
        longer = [p for p in self.score if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds a space mark after another character")
        # characters that may stand beside another within a piece
        joined = {c for p in longer for c in p}
        self.breaks = "".join(c for c in "\n\t" if c not in joined)
        stop = re.escape(SPACE + self.breaks)
        self.split = re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+|[{stop}]").findall
        self.single = frozenset(p for p in longer if self.merge(p) == 1)

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.single else self.merge(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def merge(self, word: str) -> int:
        score, n = self.score, len(word)
        part: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := word[i:i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := both + part[k]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            h = before[i]
            if h >= 0 and (p := part[h] + both) in score:
                heapq.heappush(heap, (-score[p], h, p))
        return sum(1 if p in score else len(p.encode("utf-8")) for p in part if p is not None)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.split(SPACE + text.replace(" ", SPACE))))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    other = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())
            if not any(f(i) for f in other)]


_COUNTERS: dict[int, PieceCounter] = {}


def _counter(scored: list[tuple[str, float]]) -> PieceCounter:
    key = hash(tuple(scored))
    if key not in _COUNTERS:
        _COUNTERS[key] = PieceCounter(scored)
    return _COUNTERS[key]


def n_tokens(spark: SparkSession, text: Column | str, model_path: str) -> Column:
    """Column of token counts (long).  The vocabulary is read once, on the
    driver, and broadcast (tens of thousands of pieces)."""
    shipped = spark.sparkContext.broadcast(read_pieces(model_path))

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(shipped.value)
        for batch in pieces(batches):
            yield pa.array([counter.count(v.as_py() or "") for v in batch], pa.int64())

    return counted(text)
