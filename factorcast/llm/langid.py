"""Operator 9: language identification by prediction by partial matching.

Per language a byte context tree of orders 0 to 3 with escape probabilities
(method C: a context that saw n bytes, q of them distinct, gives a seen byte
count/(n+q) and escapes to the shorter context with q/(n+q)); below order 0
every byte has 1/256.  After training the statistics are frozen, so a byte's
code length depends on its context state alone: the trees of all languages
are laid out as one table state x byte x language of bits, the state being
the longest context suffix in the trees.  Scoring sums exact code lengths
over the whole text by table lookups and predicts the shortest code.

Training reads a bounded sample: about MAX_DOCS labelled texts per language
(drawn by a hash of the id; n-grams are counted in Spark), and the trees keep
at most MAX_CONTEXTS order-3 contexts, the most frequent.  Scoring is map-only.

Code lengths are fixed-point numbers of 24 binary places (rounded once a byte,
by at most 2^-25 bits), so sums over any text are exact.

Defined results: 'und' with score 0 for a null text, one without a letter,
or when no labelled text exists; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import fresh, pieces, uniform

ORDER = 3
MAX_DOCS = 1000          # labelled texts per language, about
MAX_CONTEXTS = 30_000    # order-3 contexts kept
CHUNK = 1 << 20          # bytes scored at once
PAD = b"\n" * ORDER
UNKNOWN = "und"
UNIT = 1 << 24           # code lengths are whole numbers of 1 / UNIT bits, and so add up exactly


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray       # byte -> symbol (0: never seen in training)
    state: np.ndarray        # three symbols -> state
    bits: np.ndarray         # (state * symbols + symbol, language) -> code length in 1 / UNIT bits

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1 if len(self.symbol) else 1


def _grams(data: np.ndarray) -> np.ndarray:
    """The 4-byte windows of a byte string, as numbers."""
    d = data.astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text) rows; pre-aggregated per piece of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(PAD + text.encode("utf-8").lower())
            for lang, texts in by_lang.items():
                parts = [_grams(np.frombuffer(t, np.uint8)) for t in texts if len(t) > ORDER]
                if parts:
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)),
                         pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(
        count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray,
          max_contexts: int = MAX_CONTEXTS) -> Model:
    """The frozen model of 4-gram counts (``lang`` numbers ``languages``)."""
    g = np.stack([gram >> s & 255 for s in (24, 16, 8, 0)])
    symbol = np.zeros(256, np.int64)
    seen = np.unique(np.r_[g[3], np.frombuffer(PAD, np.uint8)])
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    s = symbol[g]
    three = (s[0] * size + s[1]) * size + s[2]
    totals = np.bincount(three, weights=n, minlength=size ** 3)
    kept = np.flatnonzero(totals >= 2)
    kept = np.sort(kept[np.argsort(-totals[kept], kind="stable")][:max_contexts])
    state = np.tile(np.arange(size * size, dtype=np.int32), size)
    state[kept] = size * size + np.arange(len(kept), dtype=np.int32)
    place = np.full(size ** 3, -1, np.int64)
    place[kept] = np.arange(len(kept))
    bits = np.empty(((size * size + len(kept)) * size, len(languages)), np.int32)

    def blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, distinct = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        room = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, distinct / room, 1.0)
        return np.where(counts > 0, counts / room, escape * shorter)

    for i in range(len(languages)):
        own = lang == i
        a, b, c, d = (x[own] for x in s)
        w = n[own].astype(np.float64)
        p = blend(np.bincount(d, w, size), np.full(size, 1 / 256))
        p = blend(np.bincount(c * size + d, w, size ** 2).reshape(size, size), p[None, :])
        two = blend(np.bincount((b * size + c) * size + d, w, size ** 3)
                    .reshape(size, size, size), p[None, :, :]).reshape(-1, size)
        at = place[(a * size + b) * size + c]
        longest = np.bincount(at[at >= 0] * size + d[at >= 0], w[at >= 0], len(kept) * size)
        top = blend(longest.reshape(-1, size), two[kept % (size * size)])
        bits[:, i] = np.rint(-np.log2(np.concatenate([two, top]).ravel()) * UNIT)
    return Model(languages, symbol.astype(np.int32), state, bits)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model | None:
    """The model of a bounded sample of the labelled rows; None without any."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in
              rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    odds = F.lit(1.0)
    for name in languages:
        odds = F.when(F.col("lang") == name, min(1.0, max_docs / counts[name])).otherwise(odds)
    found = count_grams(rows.where(uniform(F.col("id"), "ppm") < odds)).toArrow()
    if not found.num_rows:
        return None
    number = {name: i for i, name in enumerate(languages)}
    return build(languages, np.array([number[x] for x in found["lang"].to_pylist()]),
                 found["gram"].to_numpy(), found["n"].to_numpy())


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language, (texts, languages)."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    size, at = model.symbols, 0
    # a text longer than a chunk is cut into parts that carry their context along
    parts: list[tuple[int, bytes]] = []
    for i, text in enumerate(texts):
        data = PAD + text
        parts += [(i, data[k:k + CHUNK + ORDER]) for k in range(0, len(text), CHUNK)]
    while at < len(parts):
        held, end = 0, at
        while end < len(parts) and (end == at or held + len(parts[end][1]) <= CHUNK):
            held += len(parts[end][1])
            end += 1
        group = parts[at:end]
        sym = model.symbol[np.frombuffer(b"".join(p for _, p in group), np.uint8)]
        three = (sym[:-3] * size + sym[1:-2]) * size + sym[2:-1]
        cost = model.bits[model.state[three] * np.int64(size) + sym[3:]]
        lengths = np.array([len(p) for _, p in group])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        # windows that reach into the next piece belong to none
        edge = np.concatenate([np.r_[s, s + n - ORDER] for s, n in zip(starts, lengths)])
        sums = np.add.reduceat(np.r_[cost, np.zeros((1, cost.shape[1]), np.int32)],
                               np.minimum(edge, len(cost)), axis=0, dtype=np.int64)[::2]
        np.add.at(out, [i for i, _ in group], sums)
        at = end
    return out / UNIT


def predict(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """Column struct<lang, score, rate>: the predicted language, its share of
    2^-bits over all languages, and its code length in bits a byte (null if
    nothing is predicted)."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                       F.lit(None).cast("double").alias("rate"))
    if model is None:
        return nothing
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rate double")
    def ppm(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        names = np.array(m.languages, dtype=object)
        for batch in pieces(batches):
            texts = [(v.as_py() or "").encode("utf-8").lower() for v in batch]
            bits = code_lengths(m, texts) if texts else np.zeros((0, len(names)))
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            least = bits.min(axis=1, keepdims=True) if len(bits) else bits
            share = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
            rate = least[:, 0] / np.maximum([len(t) for t in texts], 1) if len(bits) else share
            yield pa.StructArray.from_arrays(
                [pa.array(names[best].tolist(), pa.string()), pa.array(share, pa.float64()),
                 pa.array(rate, pa.float64())], ["lang", "score", "rate"])

    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, ppm(F.when(has_letter, text))).otherwise(nothing)


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text",
                  ) -> tuple[DataFrame, str]:
    """``docs`` plus one struct column <lang, score, rate>, and that column's name."""
    name = fresh(docs, "language")
    return docs.withColumn(name, predict(docs, model, F.col(text_col).cast("string"))), name
