"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, BPE ids.

Each stage is a function of (spark, docs, sf_dir). What a stage returns is written as Parquet to the shared folder and
read back for the next one, so a lost executor costs one stage's tasks at most. All stages but the last return the
columns of ``documents``:

1. ``quality``: documents that a rule rejects go.
2. ``near_duplicates``: of each group of linked fingerprints the document with the smallest doc_id stays (one row,
   if rows repeat its doc_id and text; rows with a null doc_id stay).
3. ``decontaminate``: documents with words of a benchmark window go.
4. ``pii``: spans of personal data become their kind in angle brackets; ``n_chars`` follows the text.
5. ``bpe``: doc_id, n_tokens, ids, and the digest of the text decoded from them.

Nulls, empty texts, repeated rows and extra columns are handled as each operator's module says; an empty table passes
through as an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, pii, quality, simhash
from tidemark.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cascade(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs, pii.train(pii.labelled_sentences(spark)))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
#: Fingerprints, trained fields and BPE ids have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
