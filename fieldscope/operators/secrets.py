"""Unreadable values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECRET = "<secret>"


def mask_secrets(entries: DataFrame, value: str = "value") -> DataFrame:
    """Entries with readable keys; unreadable values replaced by a fixed text.

    Flags: ``key_secret`` and ``value_secret``.
    """
    shown = F.when(F.col("value_secret"), SECRET).otherwise(F.col(value))
    return entries.filter(~F.col("key_secret")).withColumn(value, shown).drop("key_secret", "value_secret")


def secret_key_counts(entries: DataFrame, group: str) -> DataFrame:
    """How many keys of each table were left out."""
    return entries.groupBy(group).agg(F.count_if("key_secret").alias("secret_keys"))
