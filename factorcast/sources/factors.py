"""Factor tables: (id BIGINT, f ARRAY<DOUBLE>), one per side.

Replaces a shared key-value store of per-id vectors with bulk DataFrame
operations: lookup is a join (SRC3), a write is a delta of a versioned table
(SNK1, ``sources.store``), a warm start reads a version back (SRC4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorcast.functions.vectors import init_product_factor, init_user_factor
from factorcast.session import broadcast_if_fits, factor_row_bytes


def init_factors(ids: DataFrame, id_col: str, k: int, side: str,
                 implicit: bool = False) -> DataFrame:
    """X4/X5 for every distinct id of ``ids``; side is 'user' or 'product'."""
    make = init_user_factor if side == "user" else init_product_factor
    d = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
    return d.select("id", make("id", k, implicit).alias("f"))


def lookup_factors(df: DataFrame, uf: DataFrame, pf: DataFrame,
                   user: str = "user", product: str = "product",
                   uf_rows: int | None = None, pf_rows: int | None = None,
                   k: int = 8) -> DataFrame:
    """SRC3 / J2: attach ``uf`` and ``pf`` (NULL when an id has no vector).

    A factor table is broadcast only when its exact row count is known
    and fits the limit; otherwise it is shuffled (AQE splits skew).  The rows
    that already carry a user's vector meet a hash table of the products of
    their partition: sorting them would spill, for they are far wider and
    more than the vectors, whose ids are distinct."""
    u = uf.select(F.col("id").alias(user), F.col("f").alias("uf"))
    p = pf.select(F.col("id").alias(product), F.col("f").alias("pf"))
    if uf_rows is not None:
        u = broadcast_if_fits(u, uf_rows, factor_row_bytes(k))
    if pf_rows is not None:
        p = broadcast_if_fits(p, pf_rows, factor_row_bytes(k), "shuffle_hash")
    else:
        p = p.hint("shuffle_hash")
    return df.join(u, user, "left").join(p, product, "left")


def upsert(old: DataFrame, changed: DataFrame) -> DataFrame:
    """SNK1: vectors of ``changed`` replace those of ``old`` by id."""
    keep = old.join(changed.select("id"), "id", "left_anti")
    return changed.select("id", "f").unionByName(keep.select("id", "f"))


def warm_start(existing: DataFrame, ids: DataFrame, id_col: str, k: int,
               side: str, implicit: bool = False) -> DataFrame:
    """SRC4: keep existing vectors, initialise only ids that lack one."""
    fresh = init_factors(ids, id_col, k, side, implicit)
    missing = fresh.join(existing.select("id"), "id", "left_anti")
    return existing.select("id", "f").unionByName(missing)
