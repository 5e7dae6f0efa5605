"""Operator 13: how quality filters interact, over every order of applying them.

Each document gets a mask: which filters it fails.  Documents are counted by
(part, mask), a table of at most 2^filters rows a part, whatever the corpus.
The rest is matrix work on that table, part by part:

* the mask matrix M (masks x filters) holds 0 where a mask fails a filter and
  infinity elsewhere; the position matrix P (orders x filters) is the inverse of
  each permutation: the step at which an order applies a filter;
* their min-plus product R[m, o] = min_f (M[m, f] + P[o, f]) is the step at which
  order o removes the documents of mask m (infinity: never);
* counts, good and toxic documents are scattered to (order, R), and a filter's
  redundant removals are the documents of its masks with R before its own step.

Defined results: a null text is empty; a null part is the empty string; a null id
is neither smaller nor greater than another, so such a row never counts as a copy,
nor makes one of another row; equal rows with one id are no copies of each other
(no smaller id).  Repeated rows count each.  Several label rows of one id count as
good (toxic) if any of them says so; labels without a document count nowhere, null
labels as 0.  An empty table gives no rows.  Other columns of the table are ignored.
Very long texts are read once, by built-in functions, as whole values.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorcast.llm.common import lookup, materialize

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
COPY = "E"          # the one filter that looks at other documents
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: too short, too repetitive,
    too many capitals, marks of markup or tables."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: bit i of the mask is filter FILTERS[i].

    Texts are read in one pass and leave a digest; the smallest id of each
    digest is pre-aggregated and joined back, hot digests by broadcast."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    failed = text_filters(F.col("text"))
    bits = sum((failed[f].cast("int") * (1 << FILTERS.index(f)) for f in failed), F.lit(0))
    seen = materialize(rows.select("id", "part", bits.cast("int").alias("bits"),
                                   F.unhex(F.sha2("text", 256)).alias("digest")))
    first = seen.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = seen.count()
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return lookup(seen, first, "digest", "id", "n", total).select(
        "id", "part", (F.col("bits") + copy * (1 << FILTERS.index(COPY))).alias("mask"))


def patterns(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic).  Rows are added up by (id, part, mask)
    before they meet the labels, so an id that many rows share stays small."""
    says = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counted = marked.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flag = {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}
    return counted.join(says, "id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * flag[c]).alias(c) for c in flag])


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, R): all permutations (order x step: filter), and the min-plus
    product of masks and positions (mask x order: step of removal, or inf)."""
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1) + 1.0
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    mask = np.where(fails == 1, 0.0, np.inf)
    return orders, (mask[:, None, :] + position[None, :, :]).min(axis=2)


def audit_part(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int) -> dict:
    """The counts of one part (vectors over masks), as order x step matrices."""
    orders, rank = removal_steps(n_filters)
    steps = np.arange(1, n_filters + 1)
    fails = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1

    def scatter(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), n_filters + 2), np.int64)
        at = np.where(np.isinf(rank), n_filters + 1, rank).astype(np.int64)
        np.add.at(out, (np.arange(len(orders))[None, :], at), weight[:, None])
        return out[:, 1:n_filters + 1]

    removed = scatter(n)
    early = rank[:, :, None] < steps                             # mask x order x step
    of_step = fails[:, orders]                                   # mask x order x step
    shapley = np.zeros(n_filters, np.int64)
    np.add.at(shapley, orders, removed)
    return {"kept": n.sum() - removed.cumsum(axis=1), "removed": removed,
            "redundant": (n[:, None, None] * (of_step & early)).sum(axis=0),
            "unique_fails": n[1 << np.arange(n_filters)][orders],
            "good_lost": scatter(good), "toxic_lost": scatter(toxic), "shapley": shapley[orders]}


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, *COUNTS): one row for each part, order of
    the filters and step."""
    n_filters = len(FILTERS)
    names = ["".join(FILTERS[i] for i in order) for order in permutations(range(n_filters))]

    def of_part(key: tuple, group: pa.Table) -> pa.Table:
        weight = np.zeros((3, 1 << n_filters), np.int64)         # at most one row a mask
        at = group["mask"].to_numpy()
        for i, c in enumerate(("n", "good", "toxic")):
            weight[i, at] = group[c].to_numpy()
        found = audit_part(*weight, n_filters)
        rows = len(names) * n_filters
        return pa.table({
            "part": pa.array([key[0].as_py()] * rows, pa.string()),
            "filter_order": np.repeat(names, n_filters).tolist(),
            "step": pa.array(np.tile(np.arange(1, n_filters + 1), len(names)), pa.int32()),
            **{c: pa.array(found[c].ravel(), pa.int64()) for c in COUNTS}})

    table = patterns(masks(docs, id_col, text_col, part_col), labels, id_col)
    return table.groupBy("part").applyInArrow(
        of_part, "part string, filter_order string, step int, "
        + ", ".join(f"{c} long" for c in COUNTS))
