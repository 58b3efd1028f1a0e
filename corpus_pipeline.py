"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Quality rules drop what they reject, near duplicates keep one document of each group, documents that hold a benchmark
item go, secrets are masked, and what is left is encoded (and decoded again, to show that no byte is lost).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import bpe, decontaminate, quality, queries, secrets, simhash
from fieldscope.session import WIDE, fresh_dir, in_few_tasks


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels).where("kept").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: that of the smallest id."""
    return in_few_tasks(simhash.one_of_each(docs), docs.count(), WIDE)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = in_few_tasks(secrets.masked(docs), docs.count(), WIDE)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the bytes that they decode to."""
    done = bpe.round_trip(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_rule())
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None  # SQL expresses neither the certified cutoffs nor the encoding; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; every stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
