"""Health snapshot: shares, rule findings, severity and ranking per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.numbers import overall_share, relative_share
from fieldscope.plans import chunk_of, running_total


def findings(metrics: dict[str, Column] | None = None) -> Column:
    """The eight rules as an array of (level, code, value), in rule order."""
    c = (metrics or {}).get
    col = lambda name: c(name) if c(name) is not None else F.col(name)
    zero = lambda name: F.coalesce(col(name), F.lit(0.0))
    recent = zero("recent_average")
    busy = recent >= 2

    def rule(condition: Column, level: Column | int, code: str, value: str) -> Column:
        level = level if isinstance(level, Column) else F.lit(level)
        return F.when(
            condition,
            F.struct(level.cast("int").alias("level"), F.lit(code).alias("code"), col(value).cast("double").alias("value")),
        )

    either = lambda high, low: F.when(busy, high).otherwise(low)
    session_floor = F.greatest(F.lit(1.0), zero("session_average") * 1.8)
    rules = F.array(
        rule(zero("over1000") > 0, either(4, 2), "freeze_1000", "over1000"),
        rule((zero("over1000") <= 0) & (zero("over500") > 0), either(3, 2), "freeze_500", "over500"),
        rule(zero("over100") > 0, either(3, 1), "spike_100", "over100"),
        rule(zero("over50") > 0, either(2, 1), "spike_50", "over50"),
        rule(recent >= 5, 3, "sustained_high", "recent_average"),
        rule((recent < 5) & busy, 2, "sustained_medium", "recent_average"),
        rule((zero("encounter_average") >= 5) & (zero("encounter_average") >= session_floor), 3, "encounter_hot", "encounter_average"),
        rule((zero("peak_time") >= 50) & (recent < 2), 1, "bursty", "peak_time"),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def with_findings(addons: DataFrame) -> DataFrame:
    """Add ``findings`` and ``severity`` (the highest level, 0 without findings)."""
    return addons.withColumn("findings", findings()).withColumn(
        "severity", F.coalesce(F.array_max(F.transform("findings", lambda f: f["level"])), F.lit(0))
    )


def loaded_only(addons: DataFrame) -> DataFrame:
    return addons.filter(F.col("loaded") & F.col("name").isNotNull())


def health_search(addons: DataFrame, text: str) -> DataFrame:
    """Addons whose name or title contains ``text``, in any case; empty keeps all."""
    needle = text.strip().lower()
    if not needle:
        return addons
    return addons.filter(
        F.contains(F.lower("name"), F.lit(needle))
        | F.contains(F.lower(F.coalesce("title", "name")), F.lit(needle))
    )


def health_snapshot(counters: DataFrame, totals: DataFrame, key: str = "client_id") -> DataFrame:
    """Loaded addons of each client next to the client's overall and application load.

    ``totals`` has one row per client (``overall_recent``, ``application_recent``).
    """
    joined = loaded_only(counters).join(totals, key, "left")
    shares = joined.withColumn("title", F.coalesce("title", "name")).withColumn(
        "addon_share", relative_share(F.col("recent_average"), F.col("overall_recent"), F.col("application_recent"))
    ).withColumn("overall_share", overall_share(F.col("overall_recent"), F.col("application_recent")))
    return with_findings(shares)


def health_rank(snapshot: DataFrame, key: str = "client_id") -> DataFrame:
    """Rank within a client: severity, then recent load, then name."""
    order = [-F.col("severity"), -F.coalesce("recent_average", F.lit(-1.0)), F.col("name")]
    return running_total(snapshot, [key], order, chunk_of(snapshot, order), F.lit(1), "rank")
