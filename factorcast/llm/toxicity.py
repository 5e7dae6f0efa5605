"""Operator 3: toxicity by a fuzzy lexicon and its contexts.

The lexicon is learned from labelled texts: whole words and word stems (four
to six letters) whose share of toxic texts exceeds that of clean ones by far.
Near copies would lend weight to their chance words, so one text per family
(equal least shingle hash) votes.  The lexicon is a trie intersected with
Levenshtein automata, made deterministic state by state as words need it, so
a misspelled term is found without comparing the word with every term.  Each
hit is judged in its window: inside a pair of quotation marks of its line, or
after a word of reporting, it is a mention, else it is direct.  Marks pair by
kind; one between letters is an apostrophe, one after a letter or digit opens
nothing.  Words of reporting are learned as terms are, in any language: words
before hits that clean texts have far more often than toxic ones.  A logistic
regression over the hits weighs them; only the labelled sample teaches it.

Bound (a documented parameter): about SAMPLE_TOXIC and SAMPLE_CLEAN labelled
texts are drawn by a hash of the id.  Terms have no bound of their own: all that
the sample gives evidence for are kept.  Scoring is map-only and reads whole texts.

Defined results: null and empty texts have no hits and get the score of
such texts; without labelled texts of both kinds every score is 0.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorcast.llm.common import materialize, pieces, uniform

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
STEMS = (4, 5, 6)
LEAST_FAMILIES = 3       # toxic families that must share a term
LEAST_RATIO = 20.0       # of a term's rate in toxic to that in clean texts
LEAST_EVIDENCE = 25.0    # of the term's likelihood ratio (G squared): chance words of few texts
WINDOW = 80              # characters around a hit
CACHE_ENTRIES = 100_000   # words whose match is kept per worker
STATE_ENTRIES = 50_000    # states of the automaton kept per worker
WORDS = re.compile(r"[^\W\d_]+")
REPORT_WORDS = 3         # words before a hit that may report it
# Quotation marks that open, and the marks that may close each.
CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
MARKS = re.compile("[" + "".join(sorted(set("".join(CLOSED_BY) + "".join(CLOSED_BY.values())))) + "]")
FEATURES = 6


def errors_allowed(letters: int) -> int:
    return 0 if letters < 4 else 1 if letters < 8 else 2


class Lexicon:
    """Trie of whole words and stems (a stem matches every word it begins),
    intersected with Levenshtein automata.

    A state of the intersection is the set of (trie node, errors) reachable on
    the letters read so far: a letter may match a branch, replace it, be
    surplus, or a branch may be skipped, each but the first for one error.
    States are made when first met and kept, so the automaton becomes a
    deterministic one that takes a lookup per letter; a node is left when no
    term below it allows that many errors.  When too many states are kept,
    all are forgotten and made anew."""

    def __init__(self, words: list[str], stems: list[str], reporting: list[str] = ()):
        self.words, self.stems, self.reporting = words, stems, frozenset(reporting)
        self.below: list[dict[str, int]] = [{}]
        self.word: list[int] = [0]          # letters of the word that ends here
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]          # most errors that a term below allows
        for whole, terms in ((True, words), (False, stems)):
            for term in terms:
                node, room = 0, errors_allowed(len(term)) if whole else 0
                for c in ["", *term]:
                    if c and c not in self.below[node]:
                        self.below[node][c] = len(self.below)
                        self.below.append({})
                        self.word.append(0)
                        self.stem.append(False)
                        self.room.append(0)
                    node = self.below[node][c] if c else 0
                    self.room[node] = max(self.room[node], room)
                if whole:
                    self.word[node] = len(term)
                else:
                    self.stem[node] = True
        self.cache: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The number of the state that holds these nodes at these fewest
        errors, and the nodes reached from them by skipping branches."""
        todo = list(least.items())
        while todo:
            node, errors = todo.pop()
            if least[node] < errors:
                continue
            for child in self.below[node].values():
                if errors < self.room[child] and errors + 1 < least.get(child, 99):
                    least[child] = errors + 1
                    todo.append((child, errors + 1))
        key = tuple(sorted(least.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.room[node] and errors < least.get(node, 99):
                least[node] = errors

        for node, errors in self.states[state]:
            reach(node, errors + 1)
            for c, child in self.below[node].items():
                reach(child, errors + (c != letter))
        to = self.moves[state][letter] = self._state(least)
        return to

    def match(self, word: str) -> int:
        """0: no term, 1: a term or stem as written, 2: a misspelled term."""
        kind = self.cache.get(word)
        if kind is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            kind = self.cache[word] = self._walk(word)
        return kind

    def _walk(self, word: str) -> int:
        node = 0
        for c in word:          # the exact path, for terms and stems as written
            node = self.below[node].get(c)
            if node is None:
                break
            if self.stem[node]:
                return 1
        else:
            if self.word[node]:
                return 1
        if len(self.states) >= STATE_ENTRIES:
            self._forget()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.states[state]:
                return 0
        most = errors_allowed(len(word) + 1)
        return 2 if any(self.word[n] and e <= min(most, errors_allowed(self.word[n]))
                        for n, e in self.states[state]) else 0

    def features(self, text: str) -> list[float]:
        """log counts of direct hits, direct misspelled hits, mentions as
        written, misspelled mentions; most hits in a window; constant."""
        low = text.lower()
        match = self.match
        if not any(map(match, set(WORDS.findall(low)))):
            return [0.0] * (FEATURES - 1) + [1.0]
        hits = [(m.start(), m.end(), kind) for m in WORDS.finditer(low)
                if (kind := match(m.group()))]
        quoted = quotations(low)
        count, dense, first = [0, 0, 0, 0], 0, 0
        for i, (start, end, kind) in enumerate(hits):
            mention = inside(quoted, start, end) or not self.reporting.isdisjoint(
                words_before(low, start))
            count[(kind - 1) + 2 * mention] += 1
            while hits[first][0] < start - WINDOW:
                first += 1
            dense = max(dense, i - first)
        return [float(np.log1p(c)) for c in count] + [float(np.log1p(dense)), 1.0]

    def reported_by(self, text: str) -> set[str]:
        """Words before the unquoted hits of a text."""
        low = text.lower()
        quoted, found = quotations(low), set()
        for m in WORDS.finditer(low):
            if self.match(m.group()) and not inside(quoted, m.start(), m.end()):
                found.update(w for w in words_before(low, m.start()) if not self.match(w))
        return found


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening, closing) places of the paired quotation marks, each pair
    within a line."""
    pairs, opened = [], None
    for m in MARKS.finditer(text):
        at, mark = m.start(), m.group()
        before, after = text[at - 1:at], text[at + 1:at + 2]
        if before.isalnum() and after.isalpha():
            continue
        if opened is not None and text.find("\n", opened, at) >= 0:
            opened = None
        if opened is not None and mark in CLOSED_BY[text[opened]]:
            pairs.append((opened, at))
            opened = None
        elif opened is None and mark in CLOSED_BY and not before.isalnum() and (
                mark == "«" or after.strip()):
            opened = at
    return pairs


def inside(pairs: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a hit lies within a pair that closes in its window."""
    i = bisect.bisect_left(pairs, (start, 0)) - 1
    return i >= 0 and end <= pairs[i][1] <= end + WINDOW


def words_before(text: str, start: int) -> list[str]:
    """The last words before a place, of its line and window."""
    low = max(text.rfind("\n", 0, start) + 1, start - WINDOW)
    return WORDS.findall(text[low:start])[-REPORT_WORDS:]


def terms_of(text: str) -> set[str]:
    """Distinct words of a text and their stems (with a closing star)."""
    words = set(WORDS.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): number of texts of (text, toxic) rows that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(terms_of(text or ""))
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string())] + [
                    pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0)],
                ["term", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(
        count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def least_shingle(text: str) -> int:
    """Least hash of a text's three-word shingles: near copies mostly share it."""
    words = text.lower().encode("utf-8").split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    return min(map(xxhash.xxh3_64_intdigest, shingles, repeat(0))) - (1 << 63)


def family(text: Column | str) -> Column:
    @F.arrow_udf("long")
    def least(texts: pa.Array) -> pa.Array:
        return pa.array([least_shingle(v.as_py() or "") for v in texts], pa.int64())

    return least(text)


def choose(rows: list[tuple[str, float]]) -> Lexicon:
    """The terms of (term, evidence) rows by evidence (whole words first when close).  A
    stem that a chosen stem begins or a chosen word continues is left out;
    words that a chosen stem begins stay, for their misspellings."""
    words, stems, begun = [], set(), set()
    for term, _ in sorted(rows, key=lambda r: (-r[1] * (1.0 if r[0][-1] == "*" else 1.05), r[0])):
        if term[-1] != "*":
            words.append(term)
            begun.update(term[:n] for n in STEMS)
        elif term[:-1] not in begun and not any(term[:n] in stems for n in STEMS):
            stems.add(term[:-1])
    return Lexicon(words, sorted(stems))


def telling(counts: DataFrame, mine: str, other: str, n_mine: int, n_other: int) -> DataFrame:
    """Rows (term, mine, other) that tell one kind of texts: enough texts of
    it, far above the other kind's rate, and with enough evidence (G squared)."""
    a, b = F.col(mine), F.col(other)
    share = (a + b) / (n_mine + n_other)
    evidence = 2 * (a * F.log(a / n_mine / share) + F.when(
        b > 0, b * F.log(b / n_other / share)).otherwise(0.0))
    return counts.where((a >= LEAST_FAMILIES) & (
        a / n_mine >= LEAST_RATIO * ((b + 0.5) / n_other))).withColumn(
        "evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight_decay: float = 0.05) -> np.ndarray:
    """Weights by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    decay = np.full(x.shape[1], weight_decay)
    decay[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + decay * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(decay + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[Lexicon, np.ndarray] | None:
    """Lexicon and weights of a bounded sample of the labelled texts; None
    unless there are texts of both kinds."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marked = materialize(marked)
    counts = {r["toxic"]: r["n"] for r in
              marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    odds = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TOXIC / counts[1])).otherwise(
        min(1.0, SAMPLE_CLEAN / counts[0]))
    drawn = marked.where(uniform(F.col("_id").cast("string"), "toxic") < odds)
    # at most about SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")
                         ).join(F.broadcast(drawn), "_id")
    sample = materialize(sample.select("_id", "text", "toxic", family("text").alias("family")))
    once = sample.dropDuplicates(["family", "toxic"])
    families = {r["toxic"]: r["n"] for r in
                once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = families.get(1, 0), families.get(0, 0)
    if not toxic or not clean:
        return None
    # terms of a bounded sample
    rows = telling(count_terms(once), "toxic", "clean", toxic, clean).collect()
    lexicon = choose([(r["term"], r["evidence"]) for r in rows])
    lexicon = Lexicon(lexicon.words, lexicon.stems, reporting_words(once, lexicon))
    shown = once.select("toxic", hits(docs.sparkSession, F.col("text"), lexicon).alias("x")).collect()
    x, y = np.array([r["x"] for r in shown]), np.array([r["toxic"] for r in shown], float)
    return lexicon, fit_logistic(x, y)


def reporting_words(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Words that stand before unquoted hits in clean texts far more often
    than in toxic ones, by the same measure as terms."""
    shipped = sample.sparkSession.sparkContext.broadcast(_parts(lexicon))

    @F.arrow_udf("array<string>")
    def before(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _rebuilt(shipped)
        for batch in pieces(batches):
            yield pa.array([sorted(own.reported_by(v.as_py() or "")) for v in batch],
                           pa.list_(pa.string()))

    hit = materialize(sample.select("toxic", before("text").alias("words")).where(F.size("words") > 0))
    texts = {r["toxic"]: r["n"] for r in
             hit.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not texts.get(0) or not texts.get(1):
        return []
    counts = hit.select("toxic", F.explode("words").alias("term")).groupBy("term").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return sorted(r["term"] for r in telling(counts, "clean", "toxic", texts[0], texts[1]).collect())


def _parts(lexicon: Lexicon) -> tuple[list[str], list[str], list[str]]:
    return lexicon.words, lexicon.stems, sorted(lexicon.reporting)


_LEXICONS: dict[tuple, Lexicon] = {}     # the latest only, with its cache of words


def _rebuilt(shipped) -> Lexicon:
    key = tuple(map(tuple, shipped.value))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(*shipped.value)
    return _LEXICONS[key]


def hits(spark: SparkSession, text: Column, lexicon: Lexicon) -> Column:
    """Column of the feature list of every text."""
    shipped = spark.sparkContext.broadcast(_parts(lexicon))

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _rebuilt(shipped)
        for batch in pieces(batches):
            yield pa.array([own.features(v.as_py() or "") for v in batch],
                           pa.list_(pa.float64()))

    return found(text)


def score(spark: SparkSession, text: Column, model: tuple[Lexicon, np.ndarray] | None) -> Column:
    """Column of the scores (0 to 1)."""
    if model is None:
        return F.lit(0.0)
    lexicon, weights = model
    shipped = spark.sparkContext.broadcast(_parts(lexicon))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _rebuilt(shipped)
        for batch in pieces(batches):
            x = np.array([own.features(v.as_py() or "") for v in batch]).reshape(-1, FEATURES)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return scored(text)
