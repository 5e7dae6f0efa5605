"""Per-user history around each event: past / future sets, last-K buffers.

Set sizes are derived from per-(user, product) first/last positions
(aggregations) plus skew-safe running counts, never by materializing a
set per event.  The last-K buffers form inside chunks of a user's stream
that get the K - 1 rows before them, so a user holding a third of all rows
is still spread across all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorcast import config
from factorcast.operators.ordering import DEFAULT_CHUNK_ROWS, count_before, counts_before


def positives(df: DataFrame, rating: str = "rating",
              threshold: float = config.POSITIVE_THRESHOLD) -> DataFrame:
    """FLT1: rows with rating > threshold."""
    return df.where(F.col(rating) > F.lit(threshold))


def first_last(df: DataFrame, idx: str = "idx", rating: str = "rating",
               threshold: float = config.POSITIVE_THRESHOLD) -> DataFrame:
    """Per (user, product): first index, last index, last positive index."""
    pos = F.when(F.col(rating) > F.lit(threshold), F.col(idx))
    return df.groupBy("user", "product").agg(
        F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"),
        F.max(pos).alias("last_pos_idx"))


def distinct_products(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Each user's distinct products in first-seen order (1-based ``pos``).

    The ordinal window runs over distinct products, so a partition holds
    at most one row per catalogue item."""
    fl = df.groupBy("user", "product").agg(F.min(idx).alias("first_idx"))
    return count_before(fl.withColumn("_one", F.lit(1)), "user", "first_idx", "_one",
                        "pos", inclusive=True).drop("_one")


def history_counts(df: DataFrame, idx: str = "idx",
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W3 + W4 + FLT2 for every event row.

    n_past    distinct products of the user at rows before this one (all ratings)
    n_future  distinct positive products of the user at this row or later
    n_before  rows of the user before this one
    n_from    rows of the user from this one on (inclusive)"""
    fl = first_last(df, idx)
    d = df.join(fl, ["user", "product"]).withColumns({
        "_first": (F.col(idx) == F.col("first_idx")).cast("int"),
        "_lastpos": F.coalesce((F.col(idx) == F.col("last_pos_idx")).cast("int"), F.lit(0)),
        "_one": F.lit(1)})
    d = counts_before(d, "user", idx, {"n_past": "_first", "_lp_before": "_lastpos", "n_before": "_one"},
                      totals={"_lp_total": "_lastpos", "_rows": "_one"}, chunk_rows=chunk_rows)
    return (d.withColumn("n_future", F.col("_lp_total") - F.col("_lp_before"))
             .withColumn("n_from", F.col("_rows") - F.col("n_before"))
             .drop("_first", "_lastpos", "_one", "_lp_before", "_lp_total", "_rows",
                   "first_idx", "last_idx", "last_pos_idx"))


def user_ordinal(df: DataFrame, idx: str = "idx", out: str = "uord",
                 chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """1-based position of each row within its user's stream (skew-safe)."""
    return count_before(df.withColumn("_one", F.lit(1)), "user", idx, "_one", out,
                        inclusive=True, chunk_rows=chunk_rows).drop("_one")


HALO_ROWS = 1 << 12         # rows of one user's stream in a chunk


def last_k_buffer(df: DataFrame, k: int, idx: str = "idx",
                  carry: list[str] | None = None,
                  chunk_rows: int = DEFAULT_CHUNK_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """For every event, the user's ``k`` newest ratings up to and
    including it.  Returns (event idx, user, pos, b_idx, b_product,
    b_rating, b_len, *carry) with pos 0 = the event itself (newest) and
    b_len the buffer's length.

    A user's stream is cut at every ``halo_rows`` rows (by the row's ordinal,
    a running count); each chunk also gets the last k - 1 rows of the chunk
    before.  So a row is shuffled once, or twice near a cut, and a window
    within the chunk collects the buffers; they are rows only after that.
    k <= 0 gives an empty buffer."""
    carry = carry or []
    o = user_ordinal(df, idx, chunk_rows=chunk_rows)
    size = max(halo_rows, k)
    item = F.struct(F.col(idx).alias("b_idx"), F.col("product").cast("long").alias("b_product"),
                    F.col("rating").alias("b_rating"))
    at = F.col("uord") - 1
    chunk = F.floor(at / F.lit(size)).cast("long")
    # the last k - 1 rows of a chunk also open the next one
    homes = F.when(at % size >= size - (k - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = o.select(F.col(idx), "user", "uord", item.alias("_item"), chunk.alias("_own"),
                    F.explode(homes).alias("_chunk"), *carry)
    w = Window.partitionBy("user", "_chunk").orderBy("uord").rowsBetween(-max(k - 1, 0), Window.currentRow)
    kept = rows.withColumn("_buffer", F.collect_list("_item").over(w)).where(
        (F.col("_chunk") == F.col("_own")) & F.lit(k > 0))
    return kept.select(
        idx, "user", F.size("_buffer").alias("b_len"), *carry,
        F.posexplode(F.reverse("_buffer")).alias("pos", "_b")).select(
        idx, "user", "pos", "_b.b_idx", "_b.b_product", "_b.b_rating", "b_len", *carry)


def replay_sequence(buffer: DataFrame, passes: int = config.REPLAY_PASSES,
                    idx: str = "idx") -> DataFrame:
    """Replay order of a buffer: newest to oldest, ``passes`` times.

    Adds ``pass`` and ``step`` (= pass * buffer length + pos); rows are
    ordered by (idx, step) when replayed."""
    p = buffer.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    return p.withColumn("step", (F.col("pass") * F.col("b_len") + F.col("pos")).cast("long"))


def exclude_past(candidates: DataFrame, past: DataFrame) -> DataFrame:
    """FLT4 / J5: candidates whose (user, product) is not in ``past``."""
    return candidates.join(past.select("user", "product").distinct(),
                           ["user", "product"], "left_anti")


def hits_semi(recommended: DataFrame, future: DataFrame) -> DataFrame:
    """Recommended rows whose (user, product) is in ``future``."""
    return recommended.join(future.select("user", "product").distinct(),
                            ["user", "product"], "left_semi")


def set_membership(past: DataFrame, future: DataFrame) -> DataFrame:
    """SET1: per user |past|, |future|, |past & future|, |future - past|."""
    p = past.select("user", "product").distinct()
    f = future.select("user", "product").distinct()
    both = p.intersect(f)
    only_f = f.exceptAll(both)

    def cnt(d, name):
        return d.groupBy("user").agg(F.count(F.lit(1)).alias(name))
    users = p.select("user").union(f.select("user")).distinct()
    out = users
    for d, name in ((p, "n_past"), (f, "n_future"), (both, "n_both"), (only_f, "n_new")):
        out = out.join(cnt(d, name), "user", "left")
    return out.fillna(0, ["n_past", "n_future", "n_both", "n_new"])


def drop_not_applicable(df: DataFrame, recall: str = "recall") -> DataFrame:
    """FLT3: drop samples whose recall is not applicable (empty future)."""
    return df.where(F.col(recall).isNotNull())


def mark_first_seen(df: DataFrame, idx: str = "idx", out: str = "is_cold") -> DataFrame:
    """Adds ``out``: no earlier row of the stream has this row's user, or
    none has its product.  Such rows are exactly the first row of a user or
    of a product: two pre-aggregated minima and a join on the unique
    ``idx``, so a hot user or product is never gathered."""
    firsts = (df.groupBy("user").agg(F.min(idx).alias(idx)).select(idx)
              .union(df.groupBy("product").agg(F.min(idx).alias(idx)).select(idx))
              .distinct().withColumn(out, F.lit(True)))
    return df.join(firsts, idx, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))
