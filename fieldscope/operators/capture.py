"""Capture sessions: percentiles, spikes, overhead, deltas, benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.numbers import METRICS, delta, exact_sum, relative_share
from fieldscope.plans import nearest_rank, top_per_key

SPIKE_LIMITS = (1, 5, 10, 50, 100)


def spike_counts(value: Column) -> list[Column]:
    """Cumulative spike buckets: samples at or above each limit."""
    return [F.count_if(value >= k).alias(f"over{k}") for k in SPIKE_LIMITS]


def with_share(samples: DataFrame) -> DataFrame:
    return samples.withColumn(
        "share", relative_share(F.col("last_time"), F.col("overall_last"), F.col("application_last"))
    )


def spike_histogram(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return samples.groupBy(*keys).agg(*spike_counts(F.col("last_time")))


def analyzer_overhead(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """P95 of the analyzer's own cost and its share of all sampled time in percent."""
    totals = samples.groupBy(*keys).agg(
        F.coalesce(exact_sum(F.col("last_time")), F.lit(0.0)).alias("_t"),
        F.coalesce(exact_sum(F.col("self_overhead")), F.lit(0.0)).alias("_o"),
    )
    p95 = nearest_rank(samples, keys, {"self_overhead": [("overhead_p95", 0.95)]})
    return totals.join(p95, list(keys), "left").select(
        *keys,
        "overhead_p95",
        F.when(F.col("_t") + F.col("_o") > 0, F.col("_o") / (F.col("_t") + F.col("_o")) * 100).alias("overhead_ratio"),
    )


def capture_summary(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per session: percentiles, spikes, shares and analyzer overhead."""
    shared = with_share(samples)
    last, own = F.col("last_time"), F.col("self_overhead")
    totals = shared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.greatest(F.lit(0.0), F.max(last)), F.lit(0.0)).alias("maximum"),
        F.coalesce(exact_sum(last), F.lit(0.0)).alias("total_sampled_time"),
        F.coalesce(exact_sum(own), F.lit(0.0)).alias("_overhead"),
        F.count_if(last > 0).alias("active_samples"),
        *spike_counts(last),
    )
    ranks = nearest_rank(
        shared,
        keys,
        {
            "last_time": [("p50", 0.50), ("p95", 0.95), ("p99", 0.99)],
            "recent_average": [("recent_p95", 0.95)],
            "self_overhead": [("overhead_p95", 0.95)],
            "share": [("share_p50", 0.50), ("share_p95", 0.95)],
        },
    )
    both = F.col("total_sampled_time") + F.col("_overhead")
    return (
        totals.join(ranks, list(keys), "left")
        .withColumn("overhead_ratio", F.when(both > 0, F.col("_overhead") / both * 100))
        .drop("_overhead")
    )


def phase_pair(counters: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Initial and final values side by side, in one aggregation."""
    pick = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    return counters.groupBy(*keys).agg(
        *[pick("initial", c).alias(f"initial_{c}") for c in cols],
        *[pick("final", c).alias(f"final_{c}") for c in cols],
        F.max((F.col("phase") == "final").cast("int")).alias("_has_final"),
        F.max((F.col("phase") == "initial").cast("int")).alias("_has_initial"),
    )


def metric_delta(counters: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Final minus initial of the 12 metrics, for sessions with both phases."""
    return (
        phase_pair(counters, METRICS, keys)
        .filter((F.col("_has_final") == 1) & (F.col("_has_initial") == 1))
        .select(*keys, *[delta(F.col(f"final_{c}"), F.col(f"initial_{c}")).alias(f"{c}_delta") for c in METRICS])
    )


def memory_delta(counters: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return phase_pair(counters, ["memory"], keys).select(
        *keys, delta(F.col("final_memory"), F.col("initial_memory")).alias("memory_delta")
    )


def benchmark_summary(calls: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Time and allocation per call of a measured function; unreadable numbers count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    filled = calls.select(
        *keys,
        zero("elapsed").cast("double").alias("elapsed"),
        zero("allocated").cast("double").alias("allocated"),
        (zero("allocated") - zero("deallocated")).cast("double").alias("net"),
    )
    n = F.col("iterations")
    totals = filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"),
        exact_sum(F.col("elapsed")).alias("_e"),
        exact_sum(F.col("allocated")).alias("_a"),
        exact_sum(F.col("net")).alias("_n"),
    )
    ranks = nearest_rank(
        filled,
        keys,
        {
            "elapsed": [("p50", 0.50), ("p95", 0.95), ("p99", 0.99), ("maximum", 1.0)],
            "allocated": [("allocated_p95", 0.95)],
            "net": [("net_p95", 0.95)],
        },
    )
    return totals.join(ranks, list(keys)).select(
        *keys,
        "iterations",
        (F.col("_e") / n).alias("mean"),
        "p50",
        "p95",
        "p99",
        "maximum",
        (F.col("_a") / n).alias("allocated_per_call"),
        "allocated_p95",
        (F.col("_n") / n).alias("net_per_call"),
        "net_p95",
        F.when(F.col("_e") > 0, n * 1000 / F.col("_e")).alias("calls_per_second"),
    )


def recent_samples(samples: DataFrame, limit: int = 720, key: str = "session_id") -> DataFrame:
    """The newest samples of each session, newest first."""
    order = [F.col("ts_us").desc(), F.col("sample_id").desc()]
    return top_per_key(samples, [key], order, limit)


def timeline_scale(samples: DataFrame, limit: int = 80, height: int = 112, key: str = "session_id") -> DataFrame:
    """Bar heights of the newest samples, oldest bar first, relative to the tallest."""
    known = samples.withColumn("_v", F.coalesce(F.col("last_time"), F.lit(0.0)))
    newest = recent_samples(known, limit, key)
    peak = newest.groupBy(key).agg(F.greatest(F.lit(0.01), F.max("_v")).alias("_peak"), F.max("rank").alias("_shown"))
    return newest.join(peak, key).select(
        key,
        (F.col("_shown") - F.col("rank") + 1).alias("bar"),
        F.greatest(F.lit(1), F.floor(height * F.col("_v") / F.col("_peak"))).cast("bigint").alias("height"),
    )


def recent_sessions(sessions: DataFrame, limit: int = 12, key: str = "client_id") -> DataFrame:
    """The newest captures of each client."""
    order = [F.col("created_at").desc(), F.col("session_id").desc()]
    return top_per_key(sessions, [key], order, limit)


def sessions_for_addon(sessions: DataFrame, addon: str) -> DataFrame:
    """Captures of one addon, newest first."""
    return sessions.filter(F.col("addon") == addon).orderBy(F.col("created_at").desc(), F.col("session_id").desc())


def capture_correlate(
    cpu: DataFrame, objects: DataFrame, storage: DataFrame, memory: DataFrame, metrics: DataFrame, key: str = "session_id"
) -> DataFrame:
    """One row per session over all layers; every side has at most one row per session."""
    joined = cpu
    for side in (objects, storage, memory, metrics):
        joined = joined.join(side, key, "left")
    return joined


def capture_actions(summary: DataFrame) -> DataFrame:
    """Spike headline, overhead warning and the next actions of a correlated capture."""
    actions = F.array(
        F.when(F.col("hot_function").isNotNull(), F.concat(F.lit("hot_function:"), F.col("hot_function"))),
        F.when(F.col("hot_object").isNotNull(), F.concat(F.lit("hot_object:"), F.col("hot_object"))),
        F.when(F.col("replacements") > 0, F.concat(F.lit("replacements:"), F.col("replacements").cast("string"))),
        F.when(F.col("storage_delta") > 0, F.concat(F.lit("storage_growth:"), F.col("storage_delta").cast("string"))),
    )
    kept = F.filter(actions, lambda a: a.isNotNull())
    return summary.withColumn(
        "headline",
        F.when(F.col("over100") > 0, F.concat(F.lit("spike_100:"), F.col("over100").cast("string")))
        .when(F.col("over50") > 0, F.concat(F.lit("spike_50:"), F.col("over50").cast("string")))
        .when(F.col("over10") == 0, "no_spike"),
    ).withColumn("overhead_warning", F.coalesce(F.col("overhead_ratio") >= 10, F.lit(False))).withColumn(
        "actions", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("none")))
    )
