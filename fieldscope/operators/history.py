"""Run history: normalising, sizes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from fieldscope.functions import wording as W
from fieldscope.functions.text import byte_truncate
from fieldscope.plans import top_per_key


def history_normalize(entries: DataFrame) -> DataFrame:
    """Bounded code and result, a definite outcome, a numeric time or none."""
    text = lambda c, limit: byte_truncate(F.coalesce(c, F.lit("")), limit, W.CUT_TEXT).alias(c)
    return entries.filter(F.col("seq").isNotNull()).select(
        *[c for c in entries.columns if c not in ("code", "result", "succeeded", "timestamp")],
        text("code", W.CODE_BYTES),
        text("result", W.RESULT_BYTES),
        F.coalesce(F.col("succeeded").try_cast("boolean"), F.lit(False)).alias("succeeded"),
        F.col("timestamp").try_cast("bigint").alias("timestamp"),
    )


def entry_bytes(tree_bytes: Column) -> Column:
    """Size of an entry as the budget counts it."""
    size = F.octet_length("code") + F.octet_length("result") + F.coalesce(tree_bytes, F.lit(0)) + 128
    return F.greatest(F.lit(W.HISTORY_ENTRY_BYTES), size).cast("bigint")


def stored_tree_bytes(nodes: DataFrame, key: str) -> DataFrame:
    """Bytes of a stored tree: strings by length, tables 48, other values 8, plus string keys."""
    value = (
        F.when(F.col("kind") == "table", 48).when(F.col("kind") == "string", F.octet_length("value")).otherwise(8)
    )
    return nodes.groupBy(key).agg(F.sum(value + F.octet_length("key")).cast("bigint").alias("tree_bytes"))


def history_prune(
    entries: DataFrame, budget: int = W.HISTORY_BYTES, smallest: int = W.HISTORY_ENTRY_BYTES
) -> DataFrame:
    """The newest entries of each account whose sizes (column ``bytes``) fit the budget.

    No entry counts less than ``smallest``, so at most ``budget / smallest`` can stay.
    """
    newest = top_per_key(entries, ["account"], [F.col("seq").desc()], budget // smallest, rank="position")
    upto = Win.partitionBy("account").orderBy("position").rowsBetween(Win.unboundedPreceding, 0)
    return newest.withColumn("running_bytes", F.sum("bytes").over(upto)).filter(F.col("running_bytes") <= budget)
