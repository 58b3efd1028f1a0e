"""Text corpora from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: its path below ``path`` and its whole text."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    root = path.rstrip("/").removeprefix("file:")
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return raw.select(
        F.regexp_replace(F.url_decode(full), "^" + _escaped(root.rstrip("/")) + "/", "").alias("file"), F.col("value").alias("text")
    )


def _escaped(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The paths of all files below ``path``, without reading them."""
    root = path.rstrip("/").removeprefix("file:")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _escaped(root) + "/", "").alias("path"))


def write_report(findings: DataFrame, summary: DataFrame, clients: DataFrame, path: str, policy: str) -> None:
    """The audit report as JSON: one small summary record, and clients and findings as lines beside it."""
    summary.select(
        F.lit("fieldscope.compatibility-audit.v1").alias("schema"),
        F.lit(policy).alias("policy"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generatedAt"),
        F.array(*[F.lit(m) for m in METHOD]).alias("method"),
        F.array(*[F.lit(m) for m in LIMITATIONS]).alias("limitations"),
        F.struct("passed", "errors", "warnings", "info").alias("summary"),
    ).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    clients.write.mode("overwrite").json(f"{path}/clients")
    findings.write.mode("overwrite").json(f"{path}/findings")


METHOD = (
    "Resolve the load closure of every build from its manifest and XML references.",
    "Compare manifests, shared load order, client profiles and event catalogs.",
    "Check literal event registrations against the catalog of the same build.",
    "Flag dynamic registrations and compatibility branches for review.",
)
LIMITATIONS = (
    "Names built at run time cannot be proven from the source text.",
    "A clean result does not replace testing in the client.",
    "The audit reports evidence; it does not rewrite sources.",
)
