"""Registered queries of the thirteen operators, and SQL for those it can express.

Each query applies its operator to a whole table with production parameters
and derives the digest columns from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from factorcast.llm import (bpe, filter_audit, itq, langid, lloyd, mixing, order_minhash,
                            piece_counts, ppm, sharding, simhash, toxicity, warc)
from factorcast.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0))
    return docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"),
        toxicity.score(spark, F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = piece_counts.n_tokens(spark, F.col("text"), public_tokenizers.path(PIECES))
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        counted.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    found = langid.predict(docs, model, F.col("text"))
    return docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"),
                       found.alias("_found")).select(
        "doc_id", "held_out", F.col("_found.lang").alias("lang_pred"), "_found.score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    return ppm.score(docs, ~F.col("held_out")).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64,
                         seed="3:").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
        .alias("centroid_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_arc_to_warc, op3_toxicity, op4_order_minhash, op5_simhash, op6_itq,
    op7_piece_counts, op8_mixing, op9_ppm_language, op10_sharding, op11_ppm_score, op12_lloyd,
    op13_filter_audit)}
QUERIES["pipeline"] = corpus_pipeline.run



def lloyd_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd's rounds over the whole vectors, one pair of CTEs a round."""
    ctes = [
        "v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], "
        "lambda x: floor(1024 * x)::BIGINT) AS x FROM embeddings WHERE len(embedding) = "
        f"{dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS k, "
        f"x AS c FROM v ORDER BY k LIMIT {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS (SELECT rid, min((d, k))[1] AS distance, min((d, k))[2] AS k FROM (SELECT rid, k, "
            "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT "
            f"AS d FROM v, c{i}) GROUP BY rid)")
        if i < rounds:
            ctes.append(
                f"c{i + 1} AS (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT k, "
                "list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS c FROM (SELECT k, j, "
                f"sum(v.x[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (rid), "
                f"range(1, {dims + 1}) t(j) GROUP BY k, j) GROUP BY k) m ON m.k = c.k)")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT vec_id, a.k AS cluster, distance,
            (sum(distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.k"""


ORACLE = {
    "op12_lloyd": lloyd_sql(),
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * len(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
              FROM labels GROUP BY 1),
        x AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good,
                coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
        i AS (SELECT range::INT AS i FROM range(1, 6)),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
              WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT o, i AS step, o[i] AS f FROM o, i),
        r AS (SELECT x.*, o, list_min([CASE WHEN fails[o[j]] THEN j ELSE 9 END
              FOR j IN [1, 2, 3, 4, 5]]) AS gone FROM x, o),
        a AS (SELECT part, s.o, step, f,
                sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN gone < step AND fails[f] THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END
                    )::BIGINT AS unique_fails,
                sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
              FROM r JOIN s ON s.o = r.o GROUP BY ALL)
        SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order,
            step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM a""",
    "op2_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        x AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex FROM p),
        b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' ||
                substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
                '') AS payload_digest FROM x),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM b)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> best THEN best END AS refers_to FROM m""",
    "op6_itq": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        f AS (SELECT * FROM v WHERE e IS NOT NULL
              AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id, vec_id AS c FROM v UNION
              SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id,
            m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''),
                '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS r FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ss,
                row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY 1),
        w AS (SELECT *, k % 3 + 1 AS w, ss::DOUBLE * 3::DOUBLE AS cap FROM s),
        o AS (SELECT *, sum(ss) OVER () AS t, sum(w) OVER () AS tw,
                sum(ss) OVER q - ss AS sb, sum(w) OVER q - w AS wb
              FROM w WINDOW q AS (ORDER BY cap / w::DOUBLE, k)),
        e AS (SELECT *, (t::DOUBLE - sb::DOUBLE * 3::DOUBLE) / (tw - wb)::DOUBLE AS open FROM o),
        z AS (SELECT arg_min(open, (cap / w::DOUBLE, k)) AS level FROM e
              WHERE cap / w::DOUBLE >= open),
        g AS (SELECT source, ss, least(cap, level * w::DOUBLE) AS target FROM e, z),
        p AS (SELECT d.*, ss, target, floor(target)::BIGINT AS budget,
                sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id) - size AS before
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        c AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS n FROM p)
        SELECT doc_id, size, ss AS source_size, target,
            (n * size + greatest(0, least(size, budget - n * ss - before)))::BIGINT AS taken FROM c""",
}
