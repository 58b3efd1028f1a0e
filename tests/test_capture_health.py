"""Capture summaries, benchmark, health rules and number formats on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fieldscope.functions import numbers as N
from fieldscope.operators import capture as C
from fieldscope.operators import health as H

SAMPLE = "session_id int, sample_id int, ts_us long, last_time double, recent_average double, overall_last double, application_last double, self_overhead double"


def test_summary_of_a_session(spark):
    rows = [(1, i, i, float(v), 1.0, 50.0, 100.0, 0.5) for i, v in enumerate([0, 1, 5, 10, 50, 100])]
    rows += [(2, 9, 9, None, None, None, None, None)]
    got = {r.session_id: r for r in C.capture_summary(spark.createDataFrame(rows, SAMPLE)).collect()}
    one = got[1]
    assert (one.sample_count, one.active_samples, one.maximum, one.total_sampled_time) == (6, 5, 100.0, 166.0)
    assert (one.p50, one.p95, one.p99) == (5.0, 100.0, 100.0)
    assert [one[f"over{k}"] for k in (1, 5, 10, 50, 100)] == [5, 4, 3, 2, 1]
    assert one.overhead_ratio == 3.0 / 169.0 * 100 and one.overhead_p95 == 0.5
    assert one.share_p95 == 100.0 / 150.0 * 100
    # No readable sample: percentiles unknown, the maximum is 0.
    two = got[2]
    assert (two.p50, two.share_p50, two.maximum, two.overhead_ratio, two.over1) == (None, None, 0.0, None, 0)


def test_relative_share_needs_a_positive_base(spark):
    df = spark.createDataFrame([(2.0, 5.0, 10.0), (2.0, 20.0, 10.0), (None, 1.0, 2.0), (-1.0, 5.0, 10.0)], "a double, o double, p double")
    got = [r.s for r in df.select(N.relative_share(F.col("a"), F.col("o"), F.col("p")).alias("s")).collect()]
    assert got == [2.0 / 7.0 * 100, None, None, 0.0]


def test_benchmark_numbers(spark):
    df = spark.createDataFrame([("f", 1.25, 2048, 512)] * 5, "run_id string, elapsed double, allocated long, deallocated long")
    r = C.benchmark_summary(df).collect()[0]
    assert (r.p95, r.maximum, r.mean, r.allocated_per_call, r.net_per_call, r.net_p95) == (1.25, 1.25, 1.25, 2048.0, 1536.0, 1536.0)
    assert r.calls_per_second == 5 * 1000 / 6.25


def test_benchmark_without_time_has_no_rate(spark):
    df = spark.createDataFrame([("f", None, None, None)], "run_id string, elapsed double, allocated long, deallocated long")
    r = C.benchmark_summary(df).collect()[0]
    assert (r.mean, r.calls_per_second, r.net_per_call) == (0.0, None, 0.0)


def test_metric_delta_needs_both_phases(spark):
    metrics = {m: 1.0 for m in N.METRICS}
    rows = [(1, "initial", *metrics.values(), 5.0), (1, "final", *[v + 2 for v in metrics.values()], None), (2, "final", *metrics.values(), 1.0)]
    df = spark.createDataFrame(rows, "session_id int, phase string, " + ", ".join(f"{m} double" for m in N.METRICS) + ", memory double")
    got = C.metric_delta(df).collect()
    assert len(got) == 1 and got[0].over10_delta == 2.0
    assert {r.session_id: r.memory_delta for r in C.memory_delta(df).collect()} == {1: None, 2: None}


METRIC = "name string, " + ", ".join(f"{m} double" for m in N.METRICS)


def health_row(name, **values):
    return (name, *[values.get(m, 0.0) for m in N.METRICS])


@pytest.mark.parametrize(
    "values, codes, severity",
    [
        ({}, [], 0),
        ({"over1000": 1.0, "over500": 2.0, "recent_average": 1.0}, [("freeze_1000", 2)], 2),
        ({"over1000": 1.0, "recent_average": 2.0}, [("freeze_1000", 4), ("sustained_medium", 2)], 4),
        ({"over500": 1.0, "recent_average": 5.0}, [("freeze_500", 3), ("sustained_high", 3)], 3),
        ({"over100": 1.0, "over50": 1.0}, [("spike_100", 1), ("spike_50", 1)], 1),
        ({"over100": 1.0, "over50": 1.0, "recent_average": 2.0}, [("spike_100", 3), ("spike_50", 2), ("sustained_medium", 2)], 3),
        ({"encounter_average": 5.0, "session_average": 2.7}, [("encounter_hot", 3)], 3),
        ({"encounter_average": 5.0, "session_average": 3.0}, [], 0),
        ({"peak_time": 50.0, "recent_average": 1.99}, [("bursty", 1)], 1),
        ({"peak_time": 50.0, "recent_average": None}, [("bursty", 1)], 1),
    ],
)
def test_findings(spark, values, codes, severity):
    r = H.with_findings(spark.createDataFrame([health_row("a", **values)], METRIC)).collect()[0]
    assert [(f.code, f.level) for f in r.findings] == codes and r.severity == severity


def test_rank_orders_by_severity_load_and_name(spark):
    rows = [
        (1, *health_row("quiet")), (1, *health_row("b", recent_average=6.0)), (1, *health_row("a", recent_average=6.0)),
        (1, *health_row("unknown", recent_average=None)), (1, *health_row("busy", recent_average=9.0)), (1, *health_row("frozen", over1000=1.0, recent_average=3.0)),
    ]
    df = H.with_findings(spark.createDataFrame(rows, "client_id int, " + METRIC))
    got = [r.name for r in H.health_rank(df).orderBy("rank").collect()]
    assert got == ["frozen", "busy", "a", "b", "quiet", "unknown"]


def test_formats_round_like_c(spark):
    values = [0.125, 0.375, 10.25, 10.35, 1.005, 1.015, 2.5, 0.0005, 0.0, 1234.56, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in df.select("v", N.fixed(F.col("v"), 2).alias("two"), N.fixed(F.col("v"), 1).alias("one"), N.fixed(F.col("v"), 0).alias("zero"), N.format_ms(F.col("v")).alias("ms")).collect():
        if r.v is None:
            assert r.two is None and r.ms == "--"
            continue
        assert (r.two, r.one, r.zero) == ("%.2f" % r.v, "%.1f" % r.v, "%.0f" % r.v)
        if r.v < 0.001:
            assert r.ms == "below 0.001 ms"


def test_byte_and_memory_formats(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1536.0,), (-2.5 * 1048576,), (None,)], "v double")
    got = df.select(N.format_bytes(F.col("v"), True).alias("b"), N.format_bytes(F.col("v")).alias("p"), N.format_memory(F.col("v"), True).alias("m")).collect()
    assert [r.b for r in got] == ["0 B", "-1 B", "+1.5 KB", "-2.50 MB", "--"]
    assert [r.p for r in got] == ["0 B", "1 B", "1.5 KB", "2.50 MB", "--"]
    assert got[2].m == "+1.5 MB"


def test_recent_samples_and_timeline(spark):
    rows = [(1, i, i * 250000, float(i), None, None, None, None) for i in range(100)]
    df = spark.createDataFrame(rows, SAMPLE)
    assert sorted(r.sample_id for r in C.recent_samples(df, 10).collect()) == list(range(90, 100))
    bars = C.timeline_scale(df).orderBy("bar").collect()
    assert len(bars) == 80 and bars[-1].height == 112 and bars[0].height == int(112 * 20 / 99)


def test_search_looks_at_name_and_title(spark):
    df = spark.createDataFrame([("Alpha", None), ("beta", "Has ALPHA"), ("c", "d")], "name string, title string")
    assert H.health_search(df, " alpha ").count() == 2
    assert H.health_search(df, "").count() == 3
