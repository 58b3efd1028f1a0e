"""Capture summaries, counters and benchmark."""

from pyspark.sql import functions as F

from fieldscope.functions import numbers as N
from fieldscope.operators import capture as C
from fieldscope.plans import nearest_rank as ranks
from fieldscope.sources.tables import typed
from workloads import views as V
from workloads.registry import query

TIMES = "sum(last_time::DECIMAL(28,6))::DOUBLE"
SHARE = """CASE WHEN application_last - overall_last + last_time > 0
  THEN greatest(0, last_time / (application_last - overall_last + last_time) * 100) END"""
OVERS = ", ".join(f"count(*) FILTER (last_time >= {k}) AS over{k}" for k in (1, 5, 10, 50, 100))


@query(
    "capture_summary",
    f"""SELECT session_id, count(*) AS sample_count,
      quantile_disc(last_time, 0.5) AS p50, quantile_disc(last_time, 0.95) AS p95, quantile_disc(last_time, 0.99) AS p99,
      coalesce(greatest(0, max(last_time)), 0) AS maximum,
      quantile_disc(recent_average, 0.95) AS recent_p95, quantile_disc(self_overhead, 0.95) AS overhead_p95,
      coalesce({TIMES}, 0) AS total_sampled_time, count(*) FILTER (last_time > 0) AS active_samples,
      quantile_disc({SHARE}, 0.5) AS share_p50, quantile_disc({SHARE}, 0.95) AS share_p95, {OVERS},
      coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0)
        / nullif(coalesce({TIMES}, 0) + coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0), 0) * 100 AS overhead_ratio
    FROM samples GROUP BY session_id""",
    ("samples",),
)
def capture_summary(spark, d):
    return C.capture_summary(V.samples(spark, d))


@query(
    "nearest_rank",
    """SELECT session_id, quantile_disc(last_time, 0.25) AS p25, quantile_disc(last_time, 0.5) AS p50,
      quantile_disc(last_time, 0.9) AS p90, max(last_time) AS p100
    FROM samples GROUP BY session_id HAVING count(last_time) > 0""",
    ("samples",),
)
def nearest_rank(spark, d):
    return ranks(V.samples(spark, d), ["session_id"], {"last_time": [("p25", 0.25), ("p50", 0.5), ("p90", 0.9), ("p100", 1.0)]})


@query("spike_histogram", f"SELECT session_id, {OVERS} FROM samples GROUP BY session_id", ("samples",))
def spike_histogram(spark, d):
    return C.spike_histogram(V.samples(spark, d))


@query(
    "analyzer_overhead",
    f"""SELECT session_id, quantile_disc(self_overhead, 0.95) AS overhead_p95,
      coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0)
        / nullif(coalesce({TIMES}, 0) + coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0), 0) * 100 AS overhead_ratio
    FROM samples GROUP BY session_id""",
    ("samples",),
)
def analyzer_overhead(spark, d):
    return C.analyzer_overhead(V.samples(spark, d))


@query(
    "metric_delta",
    "SELECT f.session_id, "
    + ", ".join(f"f.{m} - i.{m} AS {m}_delta" for m in N.METRICS)
    + " FROM metric_counters f JOIN metric_counters i USING (session_id) WHERE f.phase = 'final' AND i.phase = 'initial'",
    ("metric_counters",),
)
def metric_delta(spark, d):
    return C.metric_delta(V.metric_counters(spark, d))


@query(
    "memory_delta",
    """SELECT f.session_id, f.memory - i.memory AS memory_delta
    FROM (SELECT * FROM metric_counters WHERE phase = 'final') f
    LEFT JOIN (SELECT * FROM metric_counters WHERE phase = 'initial') i USING (session_id)""",
    ("metric_counters",),
)
def memory_delta(spark, d):
    return C.memory_delta(V.metric_counters(spark, d))


@query(
    "benchmark_summary",
    """SELECT run_id, count(*) AS iterations, sum(e::DECIMAL(28,6))::DOUBLE / count(*) AS mean,
      quantile_disc(e, 0.5) AS p50, quantile_disc(e, 0.95) AS p95, quantile_disc(e, 0.99) AS p99, max(e) AS maximum,
      sum(allocated)::DOUBLE / count(*) AS allocated_per_call, quantile_disc(allocated::DOUBLE, 0.95) AS allocated_p95,
      sum(allocated - deallocated)::DOUBLE / count(*) AS net_per_call,
      quantile_disc((allocated - deallocated)::DOUBLE, 0.95) AS net_p95,
      count(*) * 1000 / nullif(sum(e::DECIMAL(28,6))::DOUBLE, 0) AS calls_per_second
    FROM (SELECT *, coalesce(elapsed, 0) AS e FROM benchmark_samples) GROUP BY run_id""",
    ("benchmark_samples",),
)
def benchmark_summary(spark, d):
    return C.benchmark_summary(V.benchmark_samples(spark, d))


@query(
    "recent_samples",
    """SELECT session_id, sample_id, last_time, row_number() OVER w AS rank FROM samples
    QUALIFY row_number() OVER w <= 20 WINDOW w AS (PARTITION BY session_id ORDER BY ts_us DESC, sample_id DESC)""".replace(
        "QUALIFY row_number() OVER w <= 20 WINDOW w AS (PARTITION BY session_id ORDER BY ts_us DESC, sample_id DESC)",
        "WINDOW w AS (PARTITION BY session_id ORDER BY ts_us DESC, sample_id DESC) QUALIFY rank <= 20",
    ),
    ("samples",),
)
def recent_samples(spark, d):
    return C.recent_samples(V.samples(spark, d), 20).select("session_id", "sample_id", "last_time", "rank")


@query(
    "timeline_scale",
    """WITH newest AS (
      SELECT session_id, coalesce(last_time, 0) AS v,
        row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, sample_id DESC) AS rn FROM samples)
    SELECT session_id, max(rn) OVER w - rn + 1 AS bar,
      greatest(1, floor(112 * v / greatest(0.01, max(v) OVER w)))::BIGINT AS height
    FROM newest WHERE rn <= 80 WINDOW w AS (PARTITION BY session_id)""",
    ("samples",),
)
def timeline_scale(spark, d):
    return C.timeline_scale(V.samples(spark, d))


@query(
    "metrics_scan",
    "SELECT session_id, phase, " + ", ".join(N.METRICS) + ", memory FROM metric_counters",
    ("metric_counters",),
)
def metrics_scan(spark, d):
    raw = V.metric_counters(spark, d)
    text = raw.select("session_id", "phase", *[F.col(m).cast("string").alias(m) for m in [*N.METRICS, "memory"]])
    return typed(text, "metric_counters").select("session_id", "phase", *N.METRICS, "memory")


@query(
    "relative_share",
    f"SELECT session_id, sample_id, {SHARE} AS share FROM samples",
    ("samples",),
)
def relative_share(spark, d):
    return C.with_share(V.samples(spark, d)).select("session_id", "sample_id", "share")


@query(
    "overall_share",
    """SELECT session_id, sample_id,
      CASE WHEN application_last - 100 > 0 THEN greatest(0, overall_last / (application_last - 100) * 100) END AS share
    FROM samples""",
    ("samples",),
)
def overall_share(spark, d):
    share = N.overall_share(F.col("overall_last"), F.col("application_last") - 100)
    return V.samples(spark, d).select("session_id", "sample_id", share.alias("share"))
