"""Vector and scalar column expressions (all JVM-side, inside codegen).

Factor vectors are stored as ARRAY<DOUBLE> of a known length ``k``;
every operation is unrolled over the k elements so Catalyst emits plain
arithmetic (no lambdas, no Python).  Sums run left to right, the same
order the SQL oracle and the numpy kernels use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorcast import config


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b, k: int) -> Column:
    """A . b for two length-k arrays (null if either is null)."""
    a, b = _c(a), _c(b)
    terms = [a.getItem(j) * b.getItem(j) for j in range(k)]
    return reduce(lambda x, y: x + y, terms)


def axpy(alpha, x, y, k: int) -> Column:
    """Y + alpha * x, element-wise."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    x, y = _c(x), _c(y)
    return F.array(*[y.getItem(j) + alpha * x.getItem(j) for j in range(k)])


def prediction_error(rating, uf, pf, k: int) -> Column:
    """e = r - uf . pf."""
    return _c(rating) - dot(uf, pf, k)


def init_factor(id_col, k: int, salt: int, scale_: float) -> Column:
    """Deterministic start vector for an id (see config)."""
    idc = _c(id_col).cast("long")
    elems = []
    for j in range(k):
        u = F.pmod(idc * config.INIT_ID_MULT + (j * config.INIT_J_MULT + salt),
                   F.lit(config.INIT_MOD)).cast("double") / float(config.INIT_MOD)
        elems.append(F.sqrt(u * float(scale_) / float(k)))
    return F.array(*elems)


def init_user_factor(id_col, k: int, implicit: bool = False) -> Column:
    s = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    return init_factor(id_col, k, config.USER_SALT, s)


def init_product_factor(id_col, k: int, implicit: bool = False) -> Column:
    s = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    return init_factor(id_col, k, config.PRODUCT_SALT, s)


def is_cold(uf, pf) -> Column:
    return _c(uf).isNull() | _c(pf).isNull()


def cold_start_prediction(uf, pf, k: int, default: float = config.COLD_START) -> Column:
    """Dot product when both vectors exist, else the cold-start value."""
    return F.when(is_cold(uf, pf), F.lit(float(default))).otherwise(dot(uf, pf, k))


def squared_error(rating, prediction) -> Column:
    """(r - p)^2."""
    d = _c(rating) - _c(prediction)
    return d * d


def recall_value(hits, n_future) -> Column:
    """Hits / |future| as DOUBLE."""
    return _c(hits).cast("double") / _c(n_future).cast("double")


def no_vector() -> Column:
    """An empty vector, for rows without one that go to Python: writing a run
    of null arrays to Arrow takes time quadratic in the run."""
    return F.array().cast("array<double>")


def code_to_rating(code) -> Column:
    """PRJ3: feedback code 'G' -> 1.0, anything else -> 0.0."""
    return F.when(_c(code) == config.POSITIVE_CODE, F.lit(1.0)).otherwise(F.lit(0.0))


def unpack(col, k: int, prefix: str) -> list[Column]:
    """Array -> k scalar columns ``{prefix}0..{prefix}{k-1}``."""
    c = _c(col)
    return [c.getItem(j).alias(f"{prefix}{j}") for j in range(k)]
