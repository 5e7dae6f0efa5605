"""Operator 5: SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 majority bits over the XXH64 values of word shingles
(NumPy inside Arrow batches; bits are counted in blocks, so a very long
text needs little memory).  Equal fingerprints collapse into one class
first, pre-aggregated before the shuffle, so copies are never paired.
Distinct fingerprints are cut into segments; two that differ in at most d
bits differ in at most floor(d / segments) bits of some segment, so every
fingerprint probes the Hamming ball of that radius around each of its
segment values in that segment's table, and the complete distance is
verified inside the join.  A pair that meets in several segments counts in
the first only.  The search is exact: no candidate is capped.

Three segments (balls of radius 1, 67 probes) suit up to about 10^8
distinct fingerprints; beyond, ``segments=2`` trades more probes (1,058)
for 32-bit keys.  Results are the same.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; texts with fewer words than a shingle hash the whole
sequence; a group all of whose ids are null has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import components, lookup, materialize, pieces

SEED = 42
BITS = 64
COUNT_BLOCK = 1 << 17     # hashes whose bits are unpacked at once (8 MB)


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """Unsigned XXH64 of every shingle; bytes.lower and bytes.split act on
    A-Z and on the space characters 20, 09-0D alone."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    shingles = [line[a:b - 1] for a, b in zip(starts, ends[words_per_shingle - 1:])]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64,
                       len(shingles))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes the word of bits set in over half of them."""
    runs = len(sizes)
    counts = np.zeros((runs, BITS), np.int64)
    owner = np.repeat(np.arange(runs), sizes)
    for at in range(0, len(hashes), COUNT_BLOCK):
        part, own = hashes[at:at + COUNT_BLOCK], owner[at:at + COUNT_BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    major = (counts * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprint(text: Column | str, words_per_shingle: int) -> Column:
    """The fingerprint as a (signed) long."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            out, group, held = [], [], 0
            for value in batch:
                group.append(shingle_hashes(value.as_py() or "", words_per_shingle))
                held += len(group[-1])
                if held >= COUNT_BLOCK:
                    out.append(_words(group))
                    group, held = [], 0
            if group:
                out.append(_words(group))
            yield pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())

    return simhash(text)


def _words(group: list[np.ndarray]) -> np.ndarray:
    return majority_bits(np.concatenate(group), np.array([len(g) for g in group]))


def segment_spans(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in chosen) for r in range(radius + 1)
            for chosen in combinations(range(width), r)]


def segment_value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def candidates(codes: DataFrame, code: str, ident: str, segments: int, radius: int,
               within: int, bits: int = BITS) -> DataFrame:
    """(a, b, distance): every pair of rows (``ident`` unique, a before b)
    that lies within ``radius`` in some segment and, over all bits, within
    ``within``.  Each pair comes once."""
    spans = segment_spans(segments, bits)
    key = [F.struct(F.lit(i).alias("s"), segment_value(F.col(code), lo, w).alias("v"))
           for i, (lo, w) in enumerate(spans)]
    tables = codes.select(F.col(ident).alias("b"), F.col(code).alias("cb"),
                          F.explode(F.array(*key)).alias("k")).select("b", "cb", "k.s", "k.v")

    def around(i: int, low: int, width: int) -> Column:
        value = segment_value(F.col(code), low, width)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in ball(width, radius)]),
                           lambda m: F.struct(F.lit(i).alias("s"),
                                              value.bitwiseXOR(m).alias("v")))

    balls = [around(i, lo, w) for i, (lo, w) in enumerate(spans)]
    probes = codes.select(F.col(ident).alias("a"), F.col(code).alias("ca"),
                          F.explode(F.concat(*balls)).alias("k")).select("a", "ca", "k.s", "k.v")
    apart = F.col("ca").bitwiseXOR(F.col("cb"))
    meets = [F.bit_count(segment_value(apart, lo, w)) <= radius for lo, w in spans]
    first = F.lit(len(spans))
    for i in reversed(range(len(spans))):
        first = F.when(meets[i], F.lit(i)).otherwise(first)
    return probes.join(tables, ["s", "v"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(apart) <= within) & (first == F.col("s"))
    ).select("a", "b", F.bit_count(apart).alias("distance"))


def linked_classes(prints: DataFrame, max_bits: int, segments: int, **aggregates: Column) -> DataFrame:
    """(_code, class_size, *aggregates, _component): the distinct fingerprints
    of ``prints`` and the component each belongs to, named by one of its
    fingerprints."""
    classes = materialize(prints.groupBy("_code").agg(
        F.count(F.lit(1)).alias("class_size"), *[c.alias(n) for n, c in aggregates.items()]))
    links = candidates(classes, "_code", "_code", segments, max_bits // segments, max_bits)
    found = components(links.select("a", "b")).select(
        F.col("node").alias("_code"), F.col("component").alias("_component"))
    return materialize(classes.join(found, "_code", "left").withColumn(
        "_component", F.coalesce("_component", "_code")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = 4, max_bits: int = 4,
                    segments: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id, class_size): a row per
    row of ``docs``; component_id is the smallest id that links reach."""
    prints = materialize(docs.select(
        F.col(id_col).alias("_id"),
        fingerprint(F.col(text_col).cast("string"), words_per_shingle).alias("_code")))
    classes = linked_classes(prints, max_bits, segments, _least=F.min("_id"))
    roots = classes.groupBy("_component").agg(F.min("_least").alias("component_id"))
    keyed = classes.join(roots, "_component").select(
        "_code", "component_id", "class_size", F.col("class_size").alias("_n"))
    return lookup(prints, materialize(keyed), "_code", "_id", "_n", max(1, prints.count())).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_code"), 16, "0")).alias("fingerprint"),
        "component_id", "class_size")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words_per_shingle: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest id
    (a null id comes last), of rows that share it that with the least text
    hash; of rows that repeat id and text one."""
    text = F.col(text_col).cast("string")
    prints = materialize(docs.select(
        F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"),
                 F.xxhash64(text).alias("h")).alias("_row"),
        fingerprint(text, words_per_shingle).alias("_code")))
    classes = linked_classes(prints, max_bits, segments, _first=F.min("_row"))
    kept = classes.groupBy("_component").agg(F.min("_first").alias("first")).select(
        F.col("first.id").alias("_kept_id"), F.col("first.h").alias("_kept_h"))
    rows = docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"])
                     & (F.xxhash64(docs[text_col].cast("string")) == kept["_kept_h"]), "left_semi")
    return rows.dropDuplicates([id_col, text_col])
