"""Registered queries of the operators in this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import bpe, decontaminate, infill, licenses, oracles, quality, ranking, secrets, sharding, simhash, substrings, suffixes, token_files, warc
from fieldscope.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Where this machine, and every executor, has a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_rule() -> str:
    """The pattern that goes with the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _span_total(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    done = quality.quality_rules(_documents(spark, sf_dir), labels)
    counts = [F.col(f"signals.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return done.select("doc_id", *counts, "base_failed", "kept")


@query("op2_warc_index", oracles.PAGES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_simhash_groups")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(_documents(spark, sf_dir))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_substring_dedup", oracles.WORD_WINDOWS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.substring_dedup(_documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_words",
        _span_total("removed").alias("n_removed"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"),
    )


@query("op5_secret_scan", oracles.secret_spans())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_documents(spark, sf_dir))
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(F.encode(secrets.written("spans", base), "utf-8"), 256).alias("base_sha256"),
        secrets.written("spans").alias("spans"),
    )


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_files.token_checksums(token_files.token_starts(token_files.read_tokens(spark, path)))


@query("op7_benchmark_leaks", oracles.leaks())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(_documents(spark, sf_dir), items).select("doc_id", "item_id", "start", "similarity")


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), split_rule())
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_license_scan", oracles.license_matches())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_documents(spark, sf_dir)).select("doc_id", "license", "start", "containment")


@query("op10_suffix_dedup", oracles.BYTE_STRINGS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.substring_dedup(_documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_bytes",
        _span_total("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_uniform_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.uniform_shards(_documents(spark, sf_dir), fresh_dir(spark, "shards"), shards=24)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return done.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op12_ranked_search", oracles.RANKED)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "ranked")
    ranking.build_index(_documents(spark, sf_dir), path)
    return ranking.search(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


@query("op13_fill_in_middle", oracles.INFILL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "frames")
    infill.write_frames(_documents(spark, sf_dir), path)
    return infill.digests(infill.infill(infill.read_frames(spark, path)))
