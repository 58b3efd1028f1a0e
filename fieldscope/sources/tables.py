"""Reading telemetry tables with their declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.sources.schemas import schema_of


def typed(raw: DataFrame, table: str) -> DataFrame:
    """The declared columns of ``table`` with their types: what is absent or cannot be read becomes null."""
    have = {field.name: field.dataType for field in raw.schema}

    def column(field):
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if have[field.name] == field.dataType:
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return raw.select(*[column(field) for field in schema_of(table)])


def read_table(spark: SparkSession, path: str, table: str, format: str = "parquet") -> DataFrame:
    """A stored table in its declared form. Text formats are read with the declared names as strings first."""
    reader = spark.read.format(format)
    if format in ("csv", "json"):
        plain = all(f.dataType.typeName() not in ("array", "struct", "map") for f in schema_of(table))
        if plain:
            reader = reader.schema(", ".join(f"`{f.name}` string" for f in schema_of(table)))
    if format == "csv":
        reader = reader.option("header", "true")
    return typed(reader.load(path), table)
