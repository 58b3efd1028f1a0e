"""Interface labels: overlay of a locale on the base table, parity of two locales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.text import placeholders


def label_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base labels, replaced where the locale has its own; locale-only keys are added."""
    side = overlay.select("key", F.col("value").alias("_own"))
    return base.select("key", "value").join(side, "key", "full").select("key", F.coalesce("_own", "value").alias("value"))


def label_parity(labels: DataFrame, base: str = "base", other: str = "enUS") -> DataFrame:
    """Every key with a problem: missing on a side, empty or non-ASCII, differing placeholders."""
    pick = lambda locale: F.max(F.when(F.col("locale") == locale, F.col("value")))
    sides = labels.groupBy("key").agg(pick(base).alias("b"), pick(other).alias("o"))
    problem = (
        F.when(F.col("o").isNull(), f"missing_{other}")
        .when(F.col("b").isNull(), f"missing_{base}")
        .when(F.col("o") == "", "empty")
        .when(F.col("o").rlike(r"[^\x00-\x7F]"), "not_ascii")
        .when(placeholders(F.col("b")) != placeholders(F.col("o")), "placeholders")
    )
    return sides.select("key", problem.alias("problem")).filter(F.col("problem").isNotNull())
