"""Text reports as tables of lines.

A report is a set of rows (report key, ``section``, ``item``, ``line``) to be read in that order. Lists
of a report stay rows of their own, so no report is gathered in one place to be written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions import numbers as N
from fieldscope.functions import report_wording as R
from fieldscope.plans import top_per_key


def report_heads(hot_functions: DataFrame, hot_objects: DataFrame, churn: DataFrame, pools: DataFrame) -> DataFrame:
    """What a report shows of its long lists: 30 functions, 30 frames, 20 churning paths, 12 pools."""
    pool_paths = top_per_key(pools.select("session_id", "path").distinct(), ["session_id"], [F.col("path")], 12)
    listed = lambda df, section: df.select(
        F.lit(section).alias("section"), "session_id", F.col("path").alias("item"), F.col("rank").cast("bigint")
    )
    return stacked(
        listed(hot_functions.filter("rank <= 30"), "function"),
        listed(hot_objects.filter("rank <= 30"), "frame"),
        listed(top_churn(churn), "churn"),
        listed(pool_paths, "pool"),
    )


def top_churn(churn: DataFrame) -> DataFrame:
    return top_per_key(churn, ["session_id"], [F.col("replacements").desc(), F.col("path")], 20)


def say(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def pair(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def whole(name: str) -> Column:
    """A count of a report, 0 if unknown."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0))


def sections(df: DataFrame, key: str | list[str], parts: dict[int, list[Column | str] | Column]) -> DataFrame:
    """Report sections of consecutive lines, all from one pass over ``df``; null lines are left out."""
    rows = []
    for number, lines in parts.items():
        if isinstance(lines, list):
            lines = F.array(*[line if isinstance(line, Column) else F.lit(line) for line in lines])
        kept = F.filter(lines, lambda t: t.isNotNull())
        section = F.lit(number).alias("section")
        numbered = F.transform(kept, lambda t, i: F.struct(i.cast("bigint").alias("item"), t.alias("line")))
        rows.append(F.transform(numbered, lambda r: F.struct(section, r["item"].alias("item"), r["line"].alias("line"))))
    return df.select(*([key] if isinstance(key, str) else key), F.inline(F.concat(*rows)))


def listing(df: DataFrame, key: str, section: int, item: Column, line: Column) -> DataFrame:
    """One report section with a line per row of a list."""
    return df.select(key, F.lit(section).alias("section"), item.cast("bigint").alias("item"), line.alias("line"))


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _finding_text(finding: Column) -> Column:
    code, value = finding["code"], finding["value"]
    text = F.lit(None).cast("string")
    for name, pattern in R.COUNT_FINDINGS.items():
        text = F.when(code == name, say(pattern, value.cast("bigint"))).otherwise(text)
    for name, pattern in R.TIME_FINDINGS.items():
        text = F.when(code == name, say(pattern, N.fixed(value, 3))).otherwise(text)
    return F.concat(F.lit("- "), text)


def _risk(severity: Column) -> Column:
    out = F.lit(R.RISK[0])
    for level, text in list(R.RISK.items())[1:]:
        out = F.when(severity >= level, text).otherwise(out)
    return out


def health_report(snapshot: DataFrame, profiler: bool = True, deep: bool = False, cpu_bound: bool | None = None) -> DataFrame:
    """Baseline report of every addon of each client of a health snapshot, keyed by (client_id, name)."""
    ms = lambda c: N.format_ms(F.col(c))
    found = F.transform("findings", _finding_text)
    findings = F.when(F.size("findings") > 0, found).otherwise(F.array(F.lit(R.NO_FINDINGS)))
    ready = lambda flag, yes, no: "- " + (yes if flag else no)
    bound = [] if cpu_bound is None else [f"- {R.CPU_BOUND}: {R.CPU_BOUND_YES if cpu_bound else R.CPU_BOUND_NO}"]
    return sections(snapshot, ["client_id", "name"], {
        0: [R.BASELINE, F.concat("title", F.lit("  ("), "name", F.lit(")")), R.CONCLUSION],
        1: F.concat(F.array(pair(R.RISK_LABEL, _risk(F.col("severity")))), findings),
        2: [
            R.CURRENT_LOAD, pair(R.RECENT, ms("recent_average")), pair(R.SHARE, N.format_percent(F.col("addon_share"))),
            say(R.ALL_SHARE, N.format_percent(F.col("overall_share"))), pair(R.MEMORY, N.format_memory(F.col("memory"))),
        ],
        3: [
            R.LONG_TERM, pair(R.SESSION_AVERAGE, ms("session_average")), pair(R.ENCOUNTER, ms("encounter_average")),
            pair(R.PEAK, ms("peak_time")), say("1/5/10ms: %d / %d / %d", *[whole(f"over{k}") for k in (1, 5, 10)]),
            say("50/100/500/1000ms: %d / %d / %d / %d", *[whole(f"over{k}") for k in (50, 100, 500, 1000)]),
        ],
        4: [R.CAPABILITIES, ready(profiler, R.PROFILER_READY, R.PROFILER_MISSING), ready(deep, R.DEEP_READY, R.DEEP_MISSING), *bound],
        5: [R.NEXT_ACTION, R.START_GUIDE],
    })


def _without(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    return sessions.select("session_id").join(rows.select("session_id").distinct(), "session_id", "left_anti")


def cpu_report(summary: DataFrame, hot_functions: DataFrame, hot_objects: DataFrame) -> DataFrame:
    """Percentiles, spikes, overhead and the hottest functions and frames of each capture.

    ``summary`` is the capture summary joined with the counter deltas.
    """
    ms = lambda c: N.format_ms(F.col(c))
    ratio = N.format_percent(F.col("overhead_ratio"))
    head = sections(summary, "session_id", {0: [
        R.CPU_TITLE, pair("P50", ms("p50")), pair("P95", ms("p95")), pair("P99", ms("p99")),
        pair(R.MAXIMUM, ms("maximum")), pair(R.RECENT_P95, ms("recent_p95")), pair(R.ANALYZER_OVERHEAD, ms("overhead_p95")),
        say(R.SAMPLE_ACTIVITY, whole("active_samples"), whole("sample_count"), ms("total_sampled_time")),
        say(R.RELATIVE_LOAD, N.format_percent(F.col("share_p50")), N.format_percent(F.col("share_p95"))),
        say(R.SAMPLE_SPIKES, *[whole(f"over{k}") for k in (1, 5, 10, 50, 100)]),
        say(R.COUNTER_SPIKES, *[whole(f"over{k}_delta") for k in (10, 50, 100, 500, 1000)]),
        F.when(F.col("overhead_ratio") >= 10, say(R.OVERHEAD_WARNING, ratio)).otherwise(say(R.OVERHEAD_OK, ratio)),
    ], 1: [R.FUNCTION_HOTSPOTS], 3: [R.FRAME_HOTSPOTS]})
    functions = hot_functions.filter("rank <= 30")
    frames = hot_objects.filter("rank <= 30")
    return stacked(
        head,
        listing(functions, "session_id", 2, F.col("rank"), say(
            R.FUNCTION_ROW, F.col("rank"), ms("elapsed"), ms("inclusive"), F.col("path"), whole("calls"), ms("average"))),
        sections(_without(summary, functions), "session_id", {2: [R.NO_HOTSPOT]}),
        listing(frames, "session_id", 4, F.col("rank"), say(
            R.FRAME_ROW, F.col("rank"), ms("elapsed"), F.col("path"), whole("calls"), ms("average"))),
        sections(_without(summary, frames), "session_id", {4: [R.NO_HOTSPOT]}),
    )


def object_report(
    lifecycle: DataFrame, totals: DataFrame, by_type: DataFrame, by_source: DataFrame, functions: DataFrame, churn: DataFrame, pools: DataFrame
) -> DataFrame:
    """Object counts, transitions, distributions, function churn and pools of each capture.

    ``totals``, ``by_type`` and ``by_source`` hold the counts of all snapshots; the last one is shown.
    """
    last = totals.groupBy("session_id").agg(
        F.max("snap_no").alias("snap_no"), F.max_by("visible", "snap_no").alias("visible"), F.max_by("on_update", "snap_no").alias("on_update")
    )
    one = (
        lifecycle.join(last, "session_id", "left").join(functions, "session_id", "left")
        .join(churn.groupBy("session_id").agg(F.sum("replacements").alias("replaced")), "session_id", "left")
    )
    final = last.select("session_id", "snap_no")
    # Larger counts first: the item number falls as the count rises.
    counted = lambda df, section, label: listing(
        df.join(final, ["session_id", "snap_no"]), "session_id", section, -F.col("objects"), pair_of(F.col(label), F.col("objects"))
    )
    shown = top_churn(churn)
    listed = top_per_key(pools, ["session_id"], [F.col("path"), F.col("pool_id")], 12)
    active = say(R.POOL_ACTIVE, whole("initial_active"), whole("final_active"), whole("peak_active"))
    reuse = say(R.POOL_REUSE, whole("acquisitions"), whole("releases"), N.fixed(F.coalesce("reuse_rate", F.lit(0.0)), 1))
    return stacked(
        sections(one, "session_id", {0: [
            R.OBJECTS_TITLE,
            say(R.OBJECT_COUNTS, *[whole(c) for c in ("initial_objects", "final_objects", "peak_objects", "newly_observed")]),
            say(R.OBJECT_TRANSITIONS, whole("hidden_transitions"), whole("activations"), N.format_percent(F.col("reuse_rate"))),
            pair(R.ON_UPDATE, whole("on_update").cast("string")), say(R.VISIBLE, whole("visible")), R.OBJECT_TYPES,
        ], 2: [R.OBJECT_SOURCES], 4: [
            R.CLOSURES,
            say(R.FUNCTION_COUNTS, *[whole(c) for c in ("functions_discovered", "function_references", "new_function_instances", "replaced")]),
        ], 6: [R.POOLS], 8: [R.LIMITS, R.TRANSIENT_LIMIT, R.POOL_HEURISTIC]}),
        counted(by_type, 1, "object_type"),
        counted(by_source, 3, "source"),
        listing(shown, "session_id", 5, F.col("rank"), say(R.CHURN_ROW, F.col("path"), whole("replacements"))),
        sections(_without(lifecycle, shown), "session_id", {5: [R.NO_CHURN]}),
        listing(listed, "session_id", 7, F.col("rank"), F.concat_ws("\n", "path", active, reuse)),
        sections(_without(lifecycle, listed), "session_id", {7: [R.NO_POOLS]}),
    )


def pair_of(label: Column, value: Column) -> Column:
    return F.concat(label, F.lit(": "), value.cast("string"))


def storage_report(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Growth of persistent storage; ``sessions`` has the declared and loaded counts, ``roots`` the deltas."""
    status = F.when(F.col("declared") == 0, "none").when(F.col("loaded") == 0, "absent").otherwise("delta")
    totals = roots.groupBy("session_id").agg(
        F.max("initial_total").alias("initial_total"), F.max("final_total").alias("final_total"), F.max("total_delta").alias("total_delta")
    )
    one = sessions.withColumn("status", status).join(totals, "session_id", "left")
    change = F.coalesce("total_delta", F.lit(0))
    total = say(
        R.STORAGE_TOTAL, N.format_bytes(F.coalesce("initial_total", F.lit(0))), N.format_bytes(F.coalesce("final_total", F.lit(0))),
        N.format_bytes(change, signed=True),
    )
    shown = roots.join(one.filter("status = 'delta'").select("session_id"), "session_id", "left_semi")
    return stacked(
        sections(one, "session_id", {0: [
            R.STORAGE_TITLE, R.STORAGE_NOTE,
            F.when(F.col("status") == "none", R.STORAGE_NOT_DECLARED)
            .when(F.col("status") == "absent", say(R.STORAGE_NOT_CREATED, whole("declared"))).otherwise(total),
            F.when((F.col("status") == "delta") & (change == 0), R.STORAGE_NO_CHANGE),
        ]}),
        # Larger changes first.
        listing(shown, "session_id", 1, -F.abs("bytes_delta"), say(
            R.STORAGE_ROOT, F.col("name"), N.format_bytes(F.col("bytes_delta"), signed=True), whole("tables_delta"), whole("entries_delta"))),
    )


def capture_report(summary: DataFrame) -> DataFrame:
    """Conclusion and next actions of each capture.

    ``summary`` is the capture summary with ``memory_delta``, the top function and object
    (path, time, calls), ``replacements`` and ``storage_delta``.
    """
    ms = lambda c: N.format_ms(F.col(c))
    dash = lambda c: F.concat(F.lit("- "), c)
    actions = [
        F.when(F.col("hot_function").isNotNull(), say(R.ACTION_FUNCTION, F.col("hot_function"), ms("hot_function_time"))),
        F.when(F.col("hot_object").isNotNull(), say(R.ACTION_OBJECT, F.col("hot_object"), ms("hot_object_time"), whole("hot_object_calls"))),
        F.when(F.col("replacements") > 0, say(R.ACTION_REPLACED, F.col("replacements"))),
        F.when(F.col("storage_delta") > 0, say(R.ACTION_STORAGE, N.format_bytes(F.col("storage_delta"), signed=True))),
    ]
    nothing = F.coalesce(*actions).isNull()
    return sections(summary, "session_id", {
        0: [
            R.CONCLUSION,
            say(R.CAPTURE_META, N.fixed(F.coalesce("elapsed", F.lit(0.0)), 2), whole("sample_count"), F.coalesce("stop_reason", F.lit("complete"))),
            F.when(F.col("over100") > 0, dash(say(R.COUNT_FINDINGS["spike_100"], F.col("over100"))))
            .when(F.col("over50") > 0, dash(say(R.COUNT_FINDINGS["spike_50"], F.col("over50"))))
            .when(F.col("over10") == 0, dash(F.lit(R.NO_SPIKE))),
            dash(pair("P95", ms("p95"))), dash(pair(R.MAXIMUM, ms("maximum"))),
            dash(pair(R.MEMORY_DELTA, N.format_memory(F.col("memory_delta"), signed=True))),
        ],
        1: [R.NEXT_ACTION, *[dash(a) for a in actions], F.when(nothing, dash(F.lit(R.NO_HOTSPOT)))],
        2: [
            R.RAW_EVIDENCE, pair("P50", ms("p50")), pair("P95", ms("p95")), pair("P99", ms("p99")),
            pair(R.MAXIMUM, ms("maximum")), say(R.RELATIVE_LOAD, N.format_percent(F.col("share_p50")), N.format_percent(F.col("share_p95"))),
        ],
    })


def timeline(samples: DataFrame) -> DataFrame:
    """A line per raw sample with ``elapsed`` seconds, in time order."""
    ms = lambda c: N.format_ms(F.col(c))
    return listing(samples, "session_id", 1, F.col("ts_us"), say(
        R.RAW_SAMPLE, N.fixed(F.col("elapsed"), 2), ms("last_time"), ms("recent_average"), ms("overall_last"), ms("application_last"), ms("self_overhead")))


def full_report(sessions: DataFrame, *parts: DataFrame) -> DataFrame:
    """Several reports and the sample timeline (last) as one, each with its part number."""
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    heading = sections(sessions, "session_id", {0: [R.TIMELINE]}).withColumn("part", F.lit(len(parts) - 1))
    return stacked(*numbered, heading).select("session_id", "part", "section", "item", "line")


def benchmark_report(summary: DataFrame, as_method: bool = False) -> DataFrame:
    ms = lambda c: N.format_ms(F.col(c))
    return sections(summary, "run_id", {0: [
        R.REPORT_TITLE, F.col("run_id"),
        say(R.BENCHMARK_META, whole("iterations"), F.lit(R.AS_METHOD if as_method else R.WITHOUT_ARGUMENTS)), R.EXACT,
        pair(R.MEAN, ms("mean")), pair("P50", ms("p50")), pair("P95", ms("p95")), pair("P99", ms("p99")), pair(R.MAXIMUM, ms("maximum")),
        pair(R.ALLOCATED, N.format_bytes(F.col("allocated_per_call"), signed=True)),
        pair(R.NET_ALLOCATION, N.format_bytes(F.col("net_per_call"), signed=True)),
        pair(R.THROUGHPUT, F.coalesce(N.fixed(F.col("calls_per_second"), 1), F.lit("--"))),
    ]})
