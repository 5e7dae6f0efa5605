"""Operator 4: Order MinHash fingerprints, built-in functions only.

The k-mers of a text are its runs of ``k`` words (the whole word sequence
if there are fewer).  Each gets its occurrence number, so a k-mer that
comes three times is three elements.  One hash of (k-mer, occurrence) deals
the elements to ``bins`` and orders them within a bin; of each bin the
``length`` minimal elements are selected, put back into text order, and
their tuple of k-mers is hashed to one signature of 16 bits.  Swapped
passages therefore change signatures although the set of k-mers is the same.
A bin of fewer elements than ``length`` would tell nothing of order; with
``dense`` (as in the query) every bin takes the first ``length`` elements from
its lower hash edge on, cyclically, so short texts act like long ones.

Everything happens inside a row with array functions, O(n log n) in its
words: sorting packed (hash, position) longs puts equal k-mers side by
side, the occurrence number is found by doubling steps among equals (only
where the predecessor is equal), and a second sort groups the bins, whose
edges are filled from the places where the bin changes.  Texts
are shuffled once, to meet the next document's head; ids alone are ranked.

Defined results: null and empty texts have the empty fingerprint, alike (1)
to another empty one only; rows that repeat an id are one place in the
order, whose next document is the text with the smallest hash of the next id.
Positions have 30 bits, and a value of Spark (below 2^31 bytes) holds at most
2^30 words, so every text fits.  Of a k-mer's hash 34 bits are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import materialize
from factorcast.operators.ordering import global_index

K = 2
BINS = 64
LENGTH = 2
POS_BITS = 30                       # a packed long: 34 bits of hash, 30 of position
SPACES = r"[\x20\x09-\x0D]+"
EMPTY = "...."


def _packed(hash_: Column, pos: Column) -> Column:
    high = F.shiftleft(F.shiftright(hash_, POS_BITS), POS_BITS)
    return high.bitwiseOR(pos.cast("long").bitwiseAND(F.lit((1 << POS_BITS) - 1)))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, POS_BITS)


def _pos_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")


def with_fingerprints(rows: DataFrame, texts: dict[str, str], k: int = K, bins: int = BINS,
                      length: int = LENGTH, dense: bool = False) -> DataFrame:
    """``rows`` plus, for each text column -> new name, its fingerprint string:
    ``bins`` signatures of four hex digits, '....' where a bin is empty (if
    ``dense``, in texts without words only)."""
    shift = 64 - (bins.bit_length() - 1)
    if bins & (bins - 1) or bins < 2:
        raise ValueError("bins must be a power of two")

    def words(text: str) -> Column:
        return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")

    def grams(n: str) -> Column:
        """Packed (hash, position) of every k-mer, in text order."""
        w = F.col(f"{n}_w")
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda i: _packed(
                F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i)))

    def numbered(n: str) -> Column:
        """Packed (hash of k-mer and occurrence number, position)."""
        s = F.col(f"{n}_s")

        def back(j: Column, by: Column) -> Column:
            return F.when(j >= by, _hash_of(F.get(s, j - by)))

        def occurrence(x: Column, j: Column) -> Column:
            doubled = F.aggregate(
                F.array(*[F.lit(1 << b) for b in reversed(range(POS_BITS))]), F.lit(0),
                lambda acc, by: F.when(back(j, acc + by) == _hash_of(x), acc + by).otherwise(acc))
            return F.when(back(j, F.lit(1)) == _hash_of(x), doubled).otherwise(F.lit(0))

        return F.transform(s, lambda x, j: _packed(
            F.xxhash64(_hash_of(x), occurrence(x, j)), _pos_of(x)))

    def of_bin(x: Column) -> Column:
        return F.shiftrightunsigned(x, shift)

    def minimal(n: str) -> Column:
        """The first ``length`` elements of every bin."""
        o = F.col(f"{n}_o")
        return F.filter(o, lambda x, j: F.when(j < length, F.lit(True)).otherwise(
            of_bin(F.get(o, j - length)) != of_bin(x)))

    def edges(n: str) -> Column:
        """Of every bin, in the order of signed numbers, the place in the sorted
        elements of the first one from its lower edge on (0 after the last)."""
        o = F.col(f"{n}_o")

        def at(j: Column) -> Column:
            return (F.shiftright(F.get(o, j), shift) + bins // 2).cast("int")

        firsts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: F.when(
            j == 0, F.lit(True)).otherwise(at(j) != at(j - 1)))
        upto = F.flatten(F.transform(firsts, lambda j: F.array_repeat(
            j, at(j) - F.when(j == 0, F.lit(-1)).otherwise(at(j - 1)))))
        return F.when(F.size(o) > 0, F.concat(upto, F.array_repeat(
            F.lit(0), bins - 1 - at(F.size(o) - 1)))).otherwise(F.array().cast("array<int>"))

    def following(n: str, b: Column) -> Column:
        """The first ``length`` elements from the lower edge of a bin on."""
        o = F.col(f"{n}_o")
        edge = F.get(F.col(f"{n}_m"), F.pmod(b + bins // 2, F.lit(bins)).cast("int"))
        return F.transform(F.slice(F.array(*[F.lit(j) for j in range(length)]), F.lit(1), F.size(o)),
                           lambda j: F.get(o, F.pmod(edge + j, F.size(o))))

    def signature(n: str, b: Column) -> Column:
        own = F.sort_array(F.transform(
            following(n, b) if dense else F.filter(F.col(f"{n}_m"), lambda x: of_bin(x) == b),
            _pos_of))
        tuple_ = F.transform(own, lambda p: _hash_of(F.get(F.col(f"{n}_k"), p)).cast("string"))
        return F.when(F.size(tuple_) == 0, F.lit(EMPTY)).otherwise(F.lower(F.substring(F.lpad(
            F.hex(F.xxhash64(F.array_join(tuple_, " "))), 16, "0"), 1, 4)))

    def joined(n: str) -> Column:
        return F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")),
            lambda b: signature(n, b)), "")

    made = {t: f"_omh_{i}" for i, t in enumerate(texts)}
    # each step is a projection of its own, so that its array is worked out once
    rows = rows.withColumns({f"{n}_w": words(t) for t, n in made.items()})
    rows = rows.withColumns({f"{n}_k": grams(n) for n in made.values()})
    rows = rows.withColumns({f"{n}_s": F.sort_array(f"{n}_k") for n in made.values()})
    rows = rows.withColumns({f"{n}_o": F.sort_array(numbered(n)) for n in made.values()})
    rows = rows.withColumns({f"{n}_m": (edges if dense else minimal)(n) for n in made.values()})
    rows = rows.withColumns({texts[t]: joined(n) for t, n in made.items()})
    return rows.drop(*[f"{n}_{s}" for n in made.values() for s in "wksom"])


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Share of equal signatures among the bins that either text fills; 1 for two empty texts."""
    def part(c: Column, i: Column) -> Column:
        return F.substring(c, i * 4 + 1, F.lit(4))

    places = F.sequence(F.lit(0), F.lit(bins - 1))
    either = F.filter(places, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY))
    same = F.filter(either, lambda i: part(a, i) == part(b, i))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        F.size(either) == 0, F.lit(1.0)).otherwise(
            F.size(same).cast("double") / F.size(either).cast("double"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        k: int = K, bins: int = BINS, length: int = LENGTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last
    floor(n/2) code points give way to the first as many of the next document
    (by id; after the last comes the first), and their likenesses."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    texts = docs.select(key.alias("_key"), F.col(id_col).alias("_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = texts.groupBy("_key", "_id").agg(
        F.min(F.xxhash64("_text")).alias("_h"),
        F.max(F.floor(F.length("_text") / 2)).cast("int").alias("_need"))
    ranked = materialize(global_index(ids, ["_id"], "_rank"))
    n = max(1, ranked.count())
    # (_key, _h) of every id, and _for: the id it comes after, which needs _need of its head
    order = materialize(ranked.select("_rank", "_key", "_h").join(ranked.select(
        F.pmod(F.col("_rank") + 1, F.lit(n)).alias("_rank"), F.col("_key").alias("_for"),
        F.col("_id").alias("_for_id"), "_need"), "_rank").drop("_rank"))

    # one exchange of the texts serves both joins (so both need the same columns);
    # the hash is compared bit by bit, lest the planner take it for a second join key
    dealt = texts.select("_key", "_text").repartition("_key")
    heads = dealt.join(order, "_key").where(
        F.xxhash64("_text").bitwiseXOR(F.col("_h")) == 0).select(
        F.col("_for").alias("_key"), F.col("_for_id").alias("_id"),
        F.substring("_text", F.lit(1), F.col("_need")).alias("_head")).dropDuplicates(["_key"])
    half = F.floor(F.length("_text") / 2).cast("int")
    rows = dealt.join(heads, "_key", "left").select(
        "_key", "_id", "_text", F.concat(
            F.substring("_text", F.lit(1), F.length("_text") - half),
            F.substring(F.coalesce("_head", F.lit("")), F.lit(1), half)).alias("_edited"))
    rows = rows.select("_key", "_id", "_text", "_edited",
                       F.length("_text").cast("long").alias("n_chars"),
                       F.xxhash64("_text").alias("_h"),
                       F.sha2("_edited", 256).alias("edited_sha256"))
    made = materialize(with_fingerprints(
        rows, {"_text": "fingerprint", "_edited": "edited_fingerprint"}, k, bins, length,
        dense=True).drop("_text", "_edited"))
    nexts = order.join(made.select("_key", "_h", F.col("fingerprint").alias("_next_print")),
                       ["_key", "_h"]).select(
        F.col("_for").alias("_key"), "_next_print").dropDuplicates(["_key"])
    return made.join(nexts, "_key", "left").select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print"), bins).alias("near_next"))
