"""Corpus pipeline: language ID, toxicity, near-duplicates, mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir),
where docs is what the stage before kept, and returns a DataFrame.  All but
the last return the columns of documents.  ``run`` writes each result as
Parquet into the shared checkpoint folder and rereads it as the next docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from factorcast.llm import bpe, langid, mixing, simhash, toxicity
from factorcast.llm.common import fresh, scratch_path, table

LANGUAGE_SCORE = 0.5      # texts without a clearly likeliest language go
LANGUAGE_BITS = 8.0       # a byte: a text that its best language codes no shorter than raw bytes goes
TOXIC_SCORE = 0.5
# encoding runs in workers that still hold what the stages before left there
ENCODING_CACHE = 16 << 20
ENCODING_ROWS = 100


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the PPM trees recognise; null texts, texts
    without a letter, and texts of no learned language or script (their best
    code is no shorter than the bytes themselves) go.  The trees learn from the
    labelled documents in docs."""
    marked, name = langid.with_language(docs, langid.train(docs))
    found = F.col(name)
    return marked.where((found["lang"] != langid.UNKNOWN) & (found["score"] >= LANGUAGE_SCORE)
                        & (found["rate"] < LANGUAGE_BITS)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; lexicon and
    weights learn from the table of labels and the texts in docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, toxicity.score(spark, F.col("text"), model)).where(
        F.col(name) < TOXIC_SCORE).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id, among
    equal or null ids that with the least text hash."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip): token ids of every text, and
    whether decoding them gives the text's bytes again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = docs.select("doc_id", "source", "text", bpe.encode_decode(
        spark, F.col("text"), ranks, public_tokenizers.PATTERN, ENCODING_CACHE, ENCODING_ROWS).alias("both"))
    return coded.select(
        "doc_id", "source", F.size("both.ids").cast("long").alias("n_tokens"), "both.ids",
        (F.col("both.decoded") == F.coalesce("text", F.lit("")).cast("binary"))
        .alias("round_trip"))


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# Hashes, trained models and token merges are beyond SQL; see tests/llm for brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
