"""Operator 8: mixing sources to target weights.

Every row gets a hash-random key; rows are range-sorted by (source, key), so
a hot source spreads over many tasks, and distributed prefix sums of the
sizes give each row its place within its source.  A source's target is cut
exactly: whole epochs first, then the rows before the remaining budget, the
row on the cut with as many words as are left.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating,
and share all words; a source gets at most ``max_epochs`` times its size,
what is above going to the others by weight until none is above.  That
level is found from prefix sums over the sources in the order of cap by
weight, not by a driver loop.

Defined results: null and blank texts have size 0 and take nothing; rows
that repeat an id are ordered by text; an all-empty table has targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import fresh, lookup, materialize, prefix_sums
from factorcast.operators.ordering import global_index

SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than 20, 09-0D; null: 0."""
    marks = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.filter(F.split(marks, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) plus ``target``."""
    ranked = materialize(global_index(
        sizes.withColumn("_null", F.col("source").isNull().cast("int")),
        ["_null", "source"], "_rank"))
    ranked = ranked.withColumn("_w", (F.col("_rank") % 3 + 1).cast("long"))
    cap = F.col("source_size") * max_epochs
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                               F.coalesce(F.sum("_w"), F.lit(0))).first()
    # capped sources come first in the order of cap by weight
    by_level = ranked.withColumn("_level", cap / F.col("_w"))
    by_level = prefix_sums(by_level, ["_level", "_rank"], "source_size", "_size_before")
    by_level = materialize(prefix_sums(by_level, ["_level", "_rank"], "_w", "_w_before"))
    open_level = (F.lit(float(total)) - F.col("_size_before") * max_epochs) / (
        F.lit(weight) - F.col("_w_before"))
    # the first source that is not capped gives the level of all the rest
    level = by_level.where(F.col("_level") >= open_level).select(
        F.min(F.struct("_level", "_rank", open_level.alias("_open")))["_open"]).first()[0] or 0.0
    return by_level.select("source", "source_size",
                           F.least(cap, F.lit(level) * F.col("_w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: str = "mix", max_epochs: float = 3.0) -> DataFrame:
    """(id, source, size, source_size, target, taken, epochs, part, text_hash):
    ``taken`` words = epochs * size + part, part being words of a further copy."""
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.col(text_col)).alias("_h")).select(
        "*", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
            F.col("_id").cast("string"), F.lit("null")))).alias("_random"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("_source")))
    per_source = materialize(rows.groupBy("_source", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    goal = targets(per_source.select("source", "source_size"), max_epochs).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("_source"), "target")
    placed = prefix_sums(rows.withColumn("_tie", F.monotonically_increasing_id()),
                         ["_source", "_random", "_id", "_h", "_tie"], "size", "_at")
    starts = prefix_sums(per_source, ["_source"], "source_size", "_start")
    keyed = materialize(starts.join(goal, "_source").select(
        "_source", "source_size", "target", "_start", "_n"))
    placed = lookup(placed, keyed, "_source", "_random", "_n", max(1, rows.count()))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))
                    .cast("long")).otherwise(F.lit(0).cast("long"))
    left = budget - F.col("epochs") * F.col("source_size") - (F.col("_at") - F.col("_start"))
    return placed.withColumn("epochs", epochs).withColumn(
        "part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part",
        F.col("_h").alias("text_hash"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept.  A
    copy on the cut keeps its whole text if at least half of it is taken and
    is left out otherwise, so that no text is torn; a source's words differ
    from its target by less than one text."""
    plan = mix(docs, id_col, text_col, source_col, seed)
    copies = F.col("epochs") + F.when(F.col("part") * 2 >= F.col("size"),
                                      (F.col("part") > 0).cast("long")).otherwise(F.lit(0))
    ident, hashed, often = (fresh(docs, n) for n in ("mix_id", "mix_hash", "mix_copies"))
    # rows that repeat id and text share one number of copies
    plan = plan.where(copies > 0).groupBy(F.col(id_col).alias(ident),
                                          F.col("text_hash").alias(hashed)).agg(
        F.max(copies).cast("int").alias(often))
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan[ident])
                       & (F.xxhash64(docs[text_col]) == plan[hashed]))
    columns = [docs[c] for c in docs.columns]
    copy = fresh(joined, "copy")
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), plan[often])).alias(copy)).drop(copy)
