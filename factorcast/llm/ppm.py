"""Operator 11: language-model scores by prediction by partial matching (PPM).

A byte-context trie of orders 0 to 5 is counted over ALL training texts and then
frozen; a text's score is the sum over its bytes, and one end symbol, of log10
probabilities.  A context that saw n bytes, q of them distinct, gives a seen byte
count/(n+q) and escapes to the next shorter context with q/(n+q) (method C);
symbols of the longer context are excluded from both sums on the way down, and what
is left below order 0 is shared by the symbols never seen.  A context never seen
costs nothing.  So the probabilities of all symbols add up to one.

The trie may be larger than any machine, and so is never broadcast:

1. texts are dealt at random to units of about UNIT_BYTES; a text longer than
   PIECE_BYTES is cut into pieces that carry the context before them;
2. each unit sends its distinct 6-byte windows and words with their training
   counts, once each, so the shuffle holds what the unit's vocabulary holds;
3. counts are added by window; the windows are sorted into shards of one 3-byte
   context suffix, where all orders down to 3 are complete (at most 2^24 windows a
   suffix, whatever the corpus); the shorter ones come from the table of 3-byte
   windows, which has at most 2^24 rows whatever the corpus and is broadcast;
4. each unit gets back the log probability of each of its windows and the count of
   each of its words, and adds them up over its texts.

The base score is the add-0.1 unigram score of words and one end per text.

Defined results: a null text is empty and has one token (its end), as has a text of
white space; a null training flag means held out.  Without a training text nothing
is known: base scores are 0 and each symbol has probability 1/255.  Repeated rows
count and are scored each.  Columns of the table other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import materialize, pieces, scratch_path

ORDER = 5
TABLE = 2                    # orders up to this one come from one table
PAD, END = 0xFE, 0xFF        # bytes that UTF-8 never has: before a text, and its end
SYMBOLS = 255                # all bytes but PAD
UNIT_BYTES = 1 << 25
SUFFIX = (1 << 8 * (TABLE + 1)) - 1
PIECE_BYTES = 1 << 23
SLICE_BYTES = 1 << 20
HELD_SLICES = 8              # whose words are looked up at once
SHARD_ROWS = 1 << 18
WORD_BYTES = 64              # longer words are known by a digest
ALPHA = 0.1
PIECES = "array<struct<last boolean, inside boolean, context binary, body binary, tail binary>>"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- pieces

def cut(data: bytes, size: int) -> Iterator[dict]:
    """The pieces of a text.  A word belongs to the piece it begins in: ``tail``
    is the rest of a word that begins in the body and goes on behind it, and
    ``inside`` says that the body begins within a word of a piece before."""
    for at in range(0, max(len(data), 1), size):
        end = min(at + size, len(data))
        body = data[at:end]
        inside = at > 0 and not SPACE.match(data, at - 1)
        begins = SPACE.search(body) if inside else True
        stop = end
        if begins and end < len(data) and not SPACE.match(data, end - 1):
            found = SPACE.search(data, end)
            stop = found.start() if found else len(data)
        yield {"last": end == len(data), "inside": inside, "context": data[max(at - ORDER, 0):at],
               "body": body, "tail": data[end:stop]}


def place(docs: DataFrame, train: Column, id_col: str, text_col: str, piece_bytes: int,
          unit_bytes: int) -> DataFrame:
    """(unit, row, id, train, last, inside, context, body, tail): the pieces of
    all texts (the body compressed), dealt to units at random by row and piece (so
    copies spread), checkpointed with that placement and order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    units = max(1, -(-total // unit_bytes))

    @F.arrow_udf(PIECES)
    def cut_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("last", pa.bool_()), ("inside", pa.bool_()),
                                   *[(c, pa.binary()) for c in ("context", "body", "tail")]]))
        press = zstandard.ZstdCompressor(1).compress
        for batch in pieces(batches, 64):
            yield pa.array([[{**p, "body": press(p["body"])} for p in cut(v.as_py(), piece_bytes)]
                            for v in batch], kind)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(train, F.lit(False)).alias("train"), text.cast("binary").alias("data"))
    parts = rows.select("row", "id", "train", F.posexplode(cut_up("data")).alias("at", "piece"))
    unit = F.pmod(F.xxhash64("row", "at"), F.lit(units)).cast("int")
    return materialize(parts.select(unit.alias("unit"), "row", "id", "train", "piece.*")
                       .repartition(units, "unit").sortWithinPartitions("unit"),
                       keep_partitioning=True)


# ---------------------------------------------------------------- windows and words of a piece

class Piece:
    """One row of :func:`place`."""

    def __init__(self, train: bool, last: bool, inside: bool, context: bytes, body: bytes, tail: bytes):
        self.train, self.last = train, last
        self.data = bytes([PAD]) * (ORDER - len(context)) + context.lower() + body.lower() + (
            bytes([END]) if last else b"")
        text = body + tail
        first = SPACE.search(text) if inside else None
        self.text = text if not inside else text[first.start():] if first else b""

    def words(self) -> list[bytes]:
        """Its tokens: words, and the end (an empty word)."""
        found = [w if len(w) <= WORD_BYTES else
                 bytes([END]) + hashlib.blake2b(w, digest_size=16).digest()
                 for w in self.text.lower().split()]
        return found + [b""] if self.last else found


def read_pieces(batch: pa.RecordBatch | pa.Table) -> Iterator[Piece]:
    """The pieces of a batch of :func:`place`, few rows at a time."""
    names = ["train", "last", "inside", "context", "body", "tail"]
    opened = zstandard.ZstdDecompressor().decompress
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        for *flags, context, body, tail in zip(*(part.column(c).to_pylist() for c in names)):
            yield Piece(*flags, context, opened(body), tail)


def slices(pieces: Iterator[Piece]) -> Iterator[list[Piece]]:
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p.data)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(group: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, sizes): the ORDER + 1 bytes that end at each symbol of the
    pieces as one number, and the number of symbols of each piece."""
    lengths = np.array([len(p.data) for p in group])
    joined = b"".join(p.data for p in group)
    count = len(joined) - ORDER
    context = np.ndarray((count + 1,), ">u4", joined, 0, (1,))        # every 4 bytes
    last = np.frombuffer(joined, np.uint8)
    grams = context[:count].astype(np.int64) << 16 | last[4:4 + count].astype(np.int64) << 8 | last[5:]
    ends = np.cumsum(lengths)
    # a window that reaches over the start of a piece belongs to none
    valid = np.ones(len(grams), bool)
    for k in range(ORDER):
        valid[ends[:-1] - ORDER + k] = False
    return grams[valid], lengths - ORDER


class Counts:
    """Distinct values with their sums, added up from coded pieces; what is
    held stays within twice the distinct values (or SLICE_BYTES)."""

    def __init__(self):
        self.held: list[tuple[pa.Array, np.ndarray]] = []
        self.rows, self.limit = 0, SLICE_BYTES

    def add(self, values: pa.Array, weights: np.ndarray) -> None:
        coded = values.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), weights, len(coded.dictionary)).astype(np.int64)
        self.held.append((coded.dictionary, n))
        self.rows += len(n)
        if self.rows > self.limit:
            self.merge()
            self.limit = max(SLICE_BYTES, 2 * self.rows)

    def merge(self) -> None:
        values, weights = zip(*self.held)
        self.held, self.rows = [], 0
        coded = pa.concat_arrays(values).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), np.concatenate(weights), len(coded.dictionary))
        self.held, self.rows = [(coded.dictionary, n.astype(np.int64))], len(n)

    def batches(self, rows: int = 1 << 16) -> Iterator[tuple[pa.Array, pa.Array]]:
        if self.held:
            self.merge()
            values, n = self.held[0]
            for at in range(0, len(n), rows):
                yield values.slice(at, rows), pa.array(n[at:at + rows])


def vocabulary(group: Iterator[Piece]) -> tuple[Counts, Counts]:
    """Distinct windows with their training counts, and words likewise."""
    grams, words = Counts(), Counts()
    for part in slices(group):
        train = np.array([p.train for p in part], float)
        found, sizes = windows(part)
        grams.add(pa.array(found), np.repeat(train, sizes))
        spoken = [p.words() for p in part]
        words.add(pa.array(list(chain.from_iterable(spoken)), pa.binary()),
                  np.repeat(train, [len(w) for w in spoken]))
    return grams, words


# ---------------------------------------------------------------- the trie

class Level:
    """The windows of one order (``keys``, sorted) with their counts, and of
    each of their contexts the sum and number of the seen ones, and the sum of
    what their symbols count one order below."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.order, self.below = order, below
        self.keys, at = np.unique(self.shorten(keys), return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.keys))
        self.contexts, at = np.unique(self.keys >> 8, return_inverse=True)
        live = (self.counts > 0).astype(float)
        under = live * below.count(self.keys) if below else live * 0
        self.sums = np.stack([np.bincount(at, v, len(self.contexts))
                              for v in (self.counts, live, under)], axis=1)

    def shorten(self, gram: np.ndarray) -> np.ndarray:
        return gram & ((1 << 8 * (self.order + 1)) - 1)

    def count(self, gram: np.ndarray) -> np.ndarray:
        """Counts of windows (of this order or a longer one); 0 if unknown."""
        return _find(self.keys, self.counts, self.shorten(gram))

    def context(self, gram: np.ndarray) -> np.ndarray:
        return _find(self.contexts, self.sums, self.shorten(gram) >> 8)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found.reshape(-1, *[1] * (values.ndim - 1)), values[at], 0)


def _positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stands in the sorted ``keys``; searched in ascending
    order, so that neighbouring searches touch the same memory."""
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])
    return at


def _in_vocabulary(coded: list[pa.DictionaryArray], vocabulary: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Where each value of each array stands in ``vocabulary``: the distinct
    values of all are looked up at once, as each look-up hashes it anew."""
    at = pc.index_in(pa.concat_arrays([c.dictionary for c in coded]), vocabulary).to_numpy()
    ends = np.cumsum([len(c.dictionary) for c in coded])
    for codes, mine in zip(coded, np.split(at, ends[:-1])):
        yield mine[codes.indices.to_numpy()]


def levels(first: int, last: int, gram: np.ndarray, n: np.ndarray, below: Level | None) -> Level:
    """The orders first to last of counted windows, above ``below``."""
    for order in range(first, last + 1):
        below = Level(order, gram, n, below)
    return below


def log_probabilities(gram: np.ndarray, n: np.ndarray, table: Level) -> np.ndarray:
    """log10 probability of the last byte of each window after the others.

    ``gram``: distinct windows, all that share their last TABLE + 1 context
    bytes; ``n``: training counts (0: not seen); ``table``: the orders up to
    TABLE of the whole corpus."""
    level = levels(TABLE + 1, ORDER, gram, n, table)
    p = np.zeros(len(gram))                     # log of the escapes so far
    done = np.zeros(len(gram), bool)
    excluded = np.zeros(len(gram))              # counts at this order of symbols seen longer
    left_out = np.zeros(len(gram))              # and their number
    while level:
        own = level.count(gram)
        total, distinct, under = level.context(gram).T
        rest, kinds = total - excluded, distinct - left_out
        room = np.maximum(rest + kinds, 1)
        found = ~done & (own > 0)
        p[found] += np.log10(own[found] / room[found])
        done |= found
        escaped = ~done & (kinds > 0)
        p[escaped] += np.log10(kinds[escaped] / room[escaped])
        excluded, left_out, level = under, distinct, level.below
    p[~done] -= np.log10(SYMBOLS - left_out[~done])
    return p


def trie(counted: DataFrame) -> DataFrame:
    """(gram, logp) of all windows of (gram, n)."""
    spark = counted.sparkSession
    path = scratch_path(spark, "ppm-windows")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    short = counted.where("n > 0").groupBy(
        F.col("gram").bitwiseAND((1 << 8 * (TABLE + 1)) - 1).alias("gram")).agg(
        F.sum("n").alias("n")).toArrow()                         # at most 2^24 rows
    shipped = spark.sparkContext.broadcast((short["gram"].to_numpy(), short["n"].to_numpy()))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by context suffix; whole suffixes are worked off
        as soon as SHARD_ROWS rows are held."""
        table = levels(0, TABLE, *shipped.value, None)
        held: list[np.ndarray] = []
        size, limit = 0, SHARD_ROWS

        def scored(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0]), pa.array(log_probabilities(rows[0], rows[1], table))],
                    ["gram", "logp"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size >= limit:
                rows = np.concatenate(held, axis=1)
                suffix = rows[0] >> 8 & SUFFIX
                whole = int(np.searchsorted(suffix, suffix[-1]))  # the last one may go on
                yield from scored(rows[:, :whole])
                held, size = [rows[:, whole:]], rows.shape[1] - whole
                limit = max(SHARD_ROWS, 2 * size)
        if held:
            yield from scored(np.concatenate(held, axis=1))
        pa.default_memory_pool().release_unused()

    suffix = F.shiftright("gram", 8).bitwiseAND(SUFFIX)
    return counted.repartition(suffix).sortWithinPartitions(suffix, "gram").select(
        "gram", "n").mapInArrow(shard, "gram long, logp double")


# ---------------------------------------------------------------- the operator

def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          piece_bytes: int = PIECE_BYTES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of
    every row; the model and the unigram counts learn from rows with ``train``."""
    spark = docs.sparkSession
    placed = place(docs, train, id_col, text_col, piece_bytes, unit_bytes)

    def send(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = vocabulary(chain.from_iterable(read_pieces(b) for b in group))
        unit, names = key[0].as_py(), ["unit", "gram", "word", "n"]
        for gram, n in grams.batches():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), unit, np.int32)), gram, pa.nulls(len(n), pa.binary()), n], names)
        for word, n in words.batches():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), unit, np.int32)), pa.nulls(len(n), pa.int64()), word, n], names)
        pa.default_memory_pool().release_unused()

    path = scratch_path(spark, "ppm-vocabulary")
    placed.groupBy("unit").applyInArrow(
        send, "unit int, gram long, word binary, n long").write.parquet(path)
    sent = spark.read.parquet(path)
    by_unit = sent.where("gram IS NOT NULL").select("unit", "gram", "n")
    grams = by_unit.select("unit", "gram").join(
        trie(by_unit.groupBy("gram").agg(F.sum("n").alias("n"))), "gram").select(
        "unit", "gram", F.lit(None).cast("binary").alias("word"), "logp")
    spoken = sent.where("word IS NOT NULL")
    known = spoken.groupBy("word").agg(F.sum("n").alias("n"))
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)),
                                F.count_if(F.col("n") > 0)).first()
    words = spoken.select("unit", "word").join(known, "word").select(
        "unit", F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("logp"))
    below = np.log10(total + ALPHA * (distinct + 1))

    def receive(key: tuple[pa.Scalar, ...], group: pa.Table, values: pa.Table) -> pa.Table:
        # sorted copies of what is needed, column by column: units are large
        order = np.argsort(values["gram"].drop_null().to_numpy())
        gram = values["gram"].drop_null().to_numpy()[order]
        logp = values["logp"].filter(values["gram"].is_valid()).to_numpy()[order]
        del order
        spoken = values["word"].drop_null()
        times = values["logp"].filter(values["word"].is_valid()).to_numpy()
        each = np.log10(times + ALPHA) - below
        n_tokens, n_known, base, scores, said = [], [], [], [], []

        def count_words() -> None:
            """Of the slices held in ``said``."""
            for n, word in zip(n_tokens[len(base):], _in_vocabulary(said, spoken)):
                # a piece within one endless word has no token
                first, some = np.cumsum(n) - n, n > 0
                known, sums = np.zeros(len(n), np.int64), np.zeros(len(n))
                if some.any():
                    known[some] = np.add.reduceat((times > 0).astype(np.int64)[word], first[some])
                    sums[some] = np.add.reduceat(each[word], first[some])
                n_known.append(known)
                base.append(sums)
            said.clear()

        for part in slices(read_pieces(group)):
            found, sizes = windows(part)
            coded = pa.array(found).dictionary_encode()
            value = logp[_positions(gram, coded.dictionary.to_numpy())][coded.indices.to_numpy()]
            scores.append(np.add.reduceat(value, np.r_[0, np.cumsum(sizes)[:-1]]))
            words = [p.words() for p in part]
            n_tokens.append(np.array([len(w) for w in words], np.int64))
            said.append(pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode())
            if len(said) == HELD_SLICES:
                count_words()
        if said:
            count_words()
        pa.default_memory_pool().release_unused()
        n_tokens, n_known, base, scores = map(np.concatenate, (n_tokens, n_known, base, scores))
        return pa.table({
            "row": group["row"], "id": group["id"], "trained": group["train"],
            "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": scores})

    scored = placed.groupBy("unit").cogroup(grams.union(words).groupBy("unit")).applyInArrow(
        receive, f"row long, id {placed.schema['id'].dataType.simpleString()}, trained boolean, "
        "n_tokens long, n_known long, base_score double, score double")
    return scored.groupBy("row", "id", "trained").agg(*[F.sum(c).alias(c) for c in (
        "n_tokens", "n_known", "base_score", "score")]).select(
        F.col("id").alias(id_col), "trained", "n_tokens", "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
