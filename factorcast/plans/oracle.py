"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Used only as the correctness oracle: the same parquet tables are views
``lineitem``, ``orders``, ``events`` ...  Every float output is rounded
to 6 places on both sides.  Double literals are written with an exponent
(``0.05e0``) because a bare ``0.05`` is DECIMAL in SQL.
"""

from __future__ import annotations

from factorcast import config
from factorcast.operators import ordering as o


def dbl(x: float) -> str:
    s = repr(float(x))
    return s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"


RATINGS = (
    'SELECT o.o_custkey AS "user", l.l_partkey AS product, '
    "CAST(ceil(l.l_quantity / 5e0) AS DOUBLE) / 2e0 AS rating, "
    "l.l_shipdate AS ts, l.l_orderkey AS okey, l.l_linenumber AS line, l.l_suppkey AS supp "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
)

FEEDBACK = (
    'SELECT event_id AS seq, user_id AS "user", '
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS product, "
    "CASE WHEN event_type IN ('purchase', 'click') THEN 'G' ELSE 'N' END AS code, "
    "CASE WHEN event_type IN ('purchase', 'click') THEN 1e0 ELSE 0e0 END AS rating, "
    "ts FROM events"
)


def row_hash(cols: list[str], seed: int = config.SEED) -> str:
    p = o.HASH_PRIME
    h = f"CAST({seed % p} AS BIGINT)"
    for c in cols:
        h = f"((({h}) * {o.HASH_STEP} + ((CAST({c} AS BIGINT) % {p}) + {p}) % {p}) % {p})"
    return f"((({h}) * {o.HASH_MIX}) % {p})"


def split_hash(cols: list[str], seed: int = config.SEED) -> str:
    return f"{row_hash(cols, seed)} % {o.HASH_BUCKETS}"


def split_flag(cols: list[str], seed: int = config.SEED,
               frac: float = config.TRAIN_FRACTION) -> str:
    cut = int(round(frac * o.HASH_BUCKETS))
    return f"({split_hash(cols, seed)} < {cut})"


def init_expr(id_col: str, j: int, k: int, salt: int, scale: float) -> str:
    x = f"(({id_col}) * {config.INIT_ID_MULT} + {j * config.INIT_J_MULT + salt}) % {config.INIT_MOD}"
    return f"sqrt(CAST({x} AS DOUBLE) / {dbl(config.INIT_MOD)} * {dbl(scale)} / {dbl(k)})"


def dot_expr(a: str, b: str, k: int) -> str:
    return " + ".join(f"{a}{j} * {b}{j}" for j in range(k))


def factor_cols(alias: str, prefix: str, k: int) -> str:
    return ", ".join(f"{alias}.f{j} AS {prefix}{j}" for j in range(k))


def init_table(source: str, id_col: str, k: int, salt: int, scale: float) -> str:
    cols = ", ".join(f"{init_expr('id', j, k, salt, scale)} AS f{j}" for j in range(k))
    return f"SELECT id, {cols} FROM (SELECT DISTINCT CAST({id_col} AS BIGINT) AS id FROM {source})"


def batch_gd_ctes(train: str, k: int, epochs: int, gamma: float, lam: float,
                  implicit: bool = False, keys: list[str] | None = None,
                  prefix: str = "") -> tuple[list[str], str, str]:
    """CTEs unrolling L1; returns (ctes, final user table, final product table).

    ``keys`` trains one model per key value (factor tables keyed by keys + id)."""
    keys = list(keys or [])
    scale = config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT
    kc = "".join(f"{c}, " for c in keys)

    def on(a, b, col_a, col_b):
        return " AND ".join([f"{a}.{c} = {b}.{c}" for c in keys] + [f"{a}.{col_a} = {b}.{col_b}"])

    def init(col, salt):
        cols = ", ".join(f"{init_expr('id', j, k, salt, scale)} AS f{j}" for j in range(k))
        return (f"SELECT {kc}id, {cols} FROM (SELECT DISTINCT {kc}CAST({col} AS BIGINT) AS id "
                f"FROM {train})")
    P = prefix
    ctes = [f"{P}u0 AS ({init(chr(34) + 'user' + chr(34), config.USER_SALT)})",
            f"{P}p0 AS ({init('product', config.PRODUCT_SALT)})"]
    g, lm = dbl(gamma), dbl(lam)
    tk = "".join(f"t.{c}, " for c in keys)
    for t in range(1, epochs + 1):
        dot = " + ".join(f"u.f{j} * p.f{j}" for j in range(k))
        ctes.append(
            f"{P}j{t} AS (SELECT {tk}t.\"user\", t.product, {factor_cols('u', 'uf', k)}, "
            f"{factor_cols('p', 'pf', k)}, t.rating - ({dot}) AS e "
            f"FROM {train} t JOIN {P}u{t-1} u ON {on('t', 'u', chr(34) + 'user' + chr(34), 'id')} "
            f"JOIN {P}p{t-1} p ON {on('t', 'p', 'product', 'id')})")
        ug = ", ".join(f"avg(e * pf{j}) AS g{j}" for j in range(k))
        pg = ", ".join(f"avg(e * uf{j}) AS g{j}" for j in range(k))
        ctes.append(f"{P}ug{t} AS (SELECT {kc}\"user\" AS id, {ug} FROM {P}j{t} GROUP BY {kc}\"user\")")
        ctes.append(f"{P}pg{t} AS (SELECT {kc}product AS id, {pg} FROM {P}j{t} GROUP BY {kc}product)")
        ak = "".join(f"a.{c}, " for c in keys)
        for side in ("u", "p"):
            upd = ", ".join(
                f"CASE WHEN g.id IS NULL THEN a.f{j} ELSE a.f{j} + {g} * (g.g{j} - {lm} * a.f{j}) END AS f{j}"
                for j in range(k))
            ctes.append(f"{P}{side}{t} AS (SELECT {ak}a.id, {upd} FROM {P}{side}{t-1} a "
                        f"LEFT JOIN {P}{side}g{t} g ON {on('a', 'g', 'id', 'id')})")
    return ctes, f"{P}u{epochs}", f"{P}p{epochs}"


def predict_select(pairs: str, ut: str, pt: str, k: int, extra: str = "") -> str:
    dot = " + ".join(f"u.f{j} * p.f{j}" for j in range(k))
    return (f"SELECT x.*{extra}, CASE WHEN u.id IS NULL OR p.id IS NULL THEN {dbl(config.COLD_START)} "
            f"ELSE {dot} END AS prediction, (u.id IS NULL OR p.id IS NULL) AS is_cold "
            f"FROM {pairs} x LEFT JOIN {ut} u ON x.\"user\" = u.id LEFT JOIN {pt} p ON x.product = p.id")


def eval_holdout(k: int, epochs: int, gamma: float, lam: float) -> str:
    ctes = [f"r AS ({RATINGS})",
            f"s AS (SELECT *, {split_flag(['okey', 'line', 'product', 'supp'])} AS is_train FROM r)",
            "tr AS (SELECT \"user\", product, rating FROM s WHERE is_train)",
            "te AS (SELECT \"user\", product, rating FROM s WHERE NOT is_train)"]
    gd, ut, pt = batch_gd_ctes("tr", k, epochs, gamma, lam)
    ctes += gd
    ctes.append(f"pr AS ({predict_select('te', ut, pt, k)})")
    return ("WITH " + ",\n".join(ctes) +
            "\nSELECT count(*) AS n, sum(CAST(is_cold AS BIGINT)) AS unknown, "
            "round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse FROM pr")


def grid_sgd_ctes(visits: str, order: str, k: int, gu: float, gi: float, lam: float,
                  blocks: int = config.GRID, implicit: bool = False,
                  prefix: str = "") -> list[str]:
    """CTEs of sequential SGD over ``visits`` (phase, rid, "user", product,
    rating and the columns of ``order``), phase after phase, stratum after
    stratum.  The blocks of a stratum share no user and no product, so step
    ``pos`` learns one row of each of them.  The last CTE ``{prefix}st`` has
    (side, id, pos, f): 'u' and 'p' vectors, 'r' scores before the update."""
    P, scale = prefix, config.SCALE_IMPLICIT if implicit else config.SCALE_EXPLICIT

    def start(col: str, side: str, salt: int) -> str:
        vec = ", ".join(init_expr("id", j, k, salt, scale) for j in range(k))
        return (f"SELECT '{side}' AS side, id, 0::BIGINT AS pos, [{vec}] AS f "
                f"FROM (SELECT DISTINCT CAST({col} AS BIGINT) AS id FROM {P}sq)")

    def new(a: str, b: str, g: float) -> str:
        return "[" + ", ".join(f"{a}[{j}] + {dbl(g)} * (e * {b}[{j}] - {dbl(lam)} * {a}[{j}])"
                               for j in range(1, k + 1)) + "]"

    dot = " + ".join(f"a.f[{j}] * b.f[{j}]" for j in range(1, k + 1))
    return [
        f'{P}gb AS (SELECT *, {row_hash([chr(34) + "user" + chr(34)])} % {blocks} AS g, '
        f"{row_hash(['product'])} % {blocks} AS pb FROM {visits})",
        f"{P}gs AS (SELECT *, (pb - g + {blocks}) % {blocks} AS s FROM {P}gb)",
        f"{P}gi AS (SELECT *, row_number() OVER (PARTITION BY phase, s, g ORDER BY {order}, \"user\", product, rating) AS i FROM {P}gs)",
        f"{P}gl AS (SELECT phase, s, max(i) AS steps FROM {P}gi GROUP BY phase, s)",
        f"{P}go AS (SELECT phase, s, sum(steps) OVER (ORDER BY phase, s) - steps AS before FROM {P}gl)",
        f'{P}sq AS MATERIALIZED (SELECT (before + i)::BIGINT AS pos, rid, "user" AS u, product AS p, rating '
        f"FROM {P}gi JOIN {P}go USING (phase, s))",
        f"{P}st(side, id, pos, f) USING KEY (side, id) AS ("
        f"{start('u', 'u', config.USER_SALT)} UNION ALL {start('p', 'p', config.PRODUCT_SALT)} "
        "UNION ALL SELECT 't', 0, 1::BIGINT, []::DOUBLE[] "
        "UNION SELECT n.* FROM ("
        f"WITH tick AS (SELECT pos FROM {P}st WHERE side = 't'), "
        f"x AS (SELECT q.rid, q.u, q.p, q.pos, a.f AS uf, b.f AS pf, {dot} AS score, "
        f"q.rating - ({dot}) AS e FROM tick JOIN {P}sq q ON q.pos = tick.pos "
        f"JOIN recurring.{P}st a ON a.side = 'u' AND a.id = q.u "
        f"JOIN recurring.{P}st b ON b.side = 'p' AND b.id = q.p) "
        f"SELECT 'u' AS side, u AS id, pos, {new('uf', 'pf', gu)} AS f FROM x "
        f"UNION ALL SELECT 'p', p, pos, {new('pf', 'uf', gi)} FROM x "
        "UNION ALL SELECT 'r', rid, pos, [score] FROM x WHERE rid IS NOT NULL "
        "UNION ALL SELECT DISTINCT 't', 0, pos + 1, []::DOUBLE[] FROM x) n)",
    ]


def factors_from(state: str, k: int) -> str:
    cols = ", ".join(f"round(f[{j + 1}], 6) AS f{j}" for j in range(k))
    return (f"SELECT CASE side WHEN 'u' THEN 'user' ELSE 'product' END AS side, id, {cols} "
            f"FROM {state} WHERE side IN ('u', 'p')")
