"""Health snapshot, findings, ranking and number formats."""

from pyspark.sql import functions as F

from fieldscope.functions import numbers as N
from fieldscope.operators import health as H
from fieldscope.operators.capture import sessions_for_addon as by_addon
from fieldscope.operators.capture import recent_sessions as newest_sessions
from workloads import views as V
from workloads.registry import query

SEVERITY = """greatest(0,
  CASE WHEN coalesce(over1000, 0) > 0 THEN CASE WHEN r >= 2 THEN 4 ELSE 2 END
       WHEN coalesce(over500, 0) > 0 THEN CASE WHEN r >= 2 THEN 3 ELSE 2 END ELSE 0 END,
  CASE WHEN over100 > 0 THEN CASE WHEN r >= 2 THEN 3 ELSE 1 END ELSE 0 END,
  CASE WHEN over50 > 0 THEN CASE WHEN r >= 2 THEN 2 ELSE 1 END ELSE 0 END,
  CASE WHEN r >= 5 THEN 3 WHEN r >= 2 THEN 2 ELSE 0 END,
  CASE WHEN coalesce(encounter_average, 0) >= 5
        AND coalesce(encounter_average, 0) >= greatest(1, coalesce(session_average, 0) * 1.8::DOUBLE) THEN 3 ELSE 0 END,
  CASE WHEN peak_time >= 50 AND r < 2 THEN 1 ELSE 0 END)"""

CODES = """concat_ws(',',
  CASE WHEN over1000 > 0 THEN 'freeze_1000' WHEN over500 > 0 THEN 'freeze_500' END,
  CASE WHEN over100 > 0 THEN 'spike_100' END, CASE WHEN over50 > 0 THEN 'spike_50' END,
  CASE WHEN r >= 5 THEN 'sustained_high' WHEN r >= 2 THEN 'sustained_medium' END,
  CASE WHEN coalesce(encounter_average, 0) >= 5
        AND coalesce(encounter_average, 0) >= greatest(1, coalesce(session_average, 0) * 1.8::DOUBLE) THEN 'encounter_hot' END,
  CASE WHEN peak_time >= 50 AND r < 2 THEN 'bursty' END)"""

ADDONS = "addons AS (SELECT *, coalesce(recent_average, 0) AS r FROM metric_counters WHERE phase = 'final')"
TOTALS = """totals AS (SELECT client_id, sum(recent_average::DECIMAL(28,6))::DOUBLE AS o,
  sum(recent_average::DECIMAL(28,6))::DOUBLE * 1.5::DOUBLE + 3 AS a FROM addons GROUP BY client_id)"""


def addons(spark, d):
    return V.metric_counters(spark, d).filter("phase = 'final'")


def client_totals(spark, d):
    return addons(spark, d).groupBy("client_id").agg(N.exact_sum(F.col("recent_average")).alias("overall_recent")).withColumn(
        "application_recent", F.col("overall_recent") * 1.5 + 3
    )


def snapshot(spark, d):
    return H.health_snapshot(addons(spark, d), client_totals(spark, d))


@query(
    "health_findings",
    f"""WITH {ADDONS} SELECT name, {CODES} AS codes, ({SEVERITY})::INTEGER AS severity FROM addons""",
    ("metric_counters",),
)
def health_findings(spark, d):
    return H.with_findings(addons(spark, d)).select(
        "name", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"), "severity"
    )


@query(
    "health_snapshot",
    f"""WITH {ADDONS}, {TOTALS}
    SELECT client_id, name, coalesce(title, name) AS title, recent_average, memory,
      CASE WHEN a - o + recent_average > 0 THEN greatest(0, recent_average / (a - o + recent_average) * 100) END AS addon_share,
      CASE WHEN a > 0 THEN greatest(0, o / a * 100) END AS overall_share, ({SEVERITY})::INTEGER AS severity
    FROM addons JOIN totals USING (client_id) WHERE loaded""",
    ("metric_counters",),
)
def health_snapshot(spark, d):
    return snapshot(spark, d).select(
        "client_id", "name", "title", "recent_average", "memory", "addon_share", "overall_share", "severity"
    )


@query(
    "health_rank",
    f"""WITH {ADDONS}, ranked AS (SELECT client_id, name, ({SEVERITY})::INTEGER AS severity, recent_average FROM addons WHERE loaded)
    SELECT client_id, name, severity, row_number() OVER (PARTITION BY client_id
      ORDER BY severity DESC, coalesce(recent_average, -1) DESC, name) AS rank FROM ranked""",
    ("metric_counters",),
)
def health_rank(spark, d):
    return H.health_rank(snapshot(spark, d)).select("client_id", "name", "severity", "rank")


@query(
    "health_search",
    "SELECT name, phase FROM metric_counters WHERE contains(lower(name), 'e 1') OR contains(lower(coalesce(title, name)), 'e 1')",
    ("metric_counters",),
)
def health_search(spark, d):
    return H.health_search(V.metric_counters(spark, d), " E 1 ").select("name", "phase")


@query("loaded_only", "SELECT name, phase FROM metric_counters WHERE loaded AND name IS NOT NULL", ("metric_counters",))
def loaded_only(spark, d):
    return H.loaded_only(V.metric_counters(spark, d)).select("name", "phase")


@query(
    "risk_label",
    f"""WITH {ADDONS} SELECT name, CASE WHEN s >= 4 THEN 'critical' WHEN s >= 3 THEN 'high' WHEN s >= 2 THEN 'watch'
      WHEN s >= 1 THEN 'history' ELSE 'none' END AS risk FROM (SELECT name, {SEVERITY} AS s FROM addons)""",
    ("metric_counters",),
)
def risk_label(spark, d):
    return H.with_findings(addons(spark, d)).select("name", N.risk_label(F.col("severity")).alias("risk"))


def sessions(spark, d):
    """Capture sessions: one per addon and phase, dated by the addon's counters."""
    return V.metric_counters(spark, d).select(
        "client_id",
        F.concat_ws("-", "name", "phase").alias("session_id"),
        F.concat(F.lit("Mod"), (F.col("session_id") % 7).cast("string")).alias("addon"),
        (F.lit(1700000000) + F.col("over5").cast("bigint") * 10).alias("created_at"),
    )


SESSIONS = """capture_sessions AS (SELECT client_id, name || '-' || phase AS session_id, 'Mod' || (session_id % 7) AS addon,
  1700000000 + over5::BIGINT * 10 AS created_at FROM metric_counters)"""


@query(
    "sessions_for_addon",
    f"WITH {SESSIONS} SELECT session_id, created_at FROM capture_sessions WHERE addon = 'Mod3'",
    ("metric_counters",),
)
def sessions_for_addon(spark, d):
    return by_addon(sessions(spark, d), "Mod3").select("session_id", "created_at")


@query(
    "recent_sessions",
    f"""WITH {SESSIONS} SELECT client_id, session_id, row_number() OVER (PARTITION BY client_id
      ORDER BY created_at DESC, session_id DESC) AS rank FROM capture_sessions QUALIFY rank <= 12""",
    ("metric_counters",),
)
def recent_sessions(spark, d):
    return newest_sessions(sessions(spark, d)).select("client_id", "session_id", "rank")


def _ms(x):
    return f"""CASE WHEN {x} IS NULL THEN '--' WHEN {x} >= 0 AND {x} < 0.001 THEN 'below 0.001 ms'
      WHEN {x} < 0.1 THEN printf('%.3fms', {x}) WHEN {x} < 10 THEN printf('%.2fms', {x}) ELSE printf('%.1fms', {x}) END"""


@query(
    "format_ms",
    f"SELECT session_id, sample_id, {_ms('last_time')} AS last_text, {_ms('self_overhead / 50')} AS small_text FROM samples",
    ("samples",),
)
def format_ms(spark, d):
    return V.samples(spark, d).select(
        "session_id",
        "sample_id",
        N.format_ms(F.col("last_time")).alias("last_text"),
        N.format_ms(F.col("self_overhead") / 50).alias("small_text"),
    )


@query(
    "format_percent",
    """SELECT sample_id, CASE WHEN x IS NULL THEN '--' WHEN x > 0 AND x < 0.01 THEN '<0.01%'
      WHEN x < 0.1 THEN printf('%.2f%%', x) WHEN x < 10 THEN printf('%.1f%%', x) ELSE printf('%.0f%%', x) END AS text
    FROM (SELECT sample_id, last_time / 5 AS x FROM samples)""",
    ("samples",),
)
def format_percent(spark, d):
    return V.samples(spark, d).select("sample_id", N.format_percent(F.col("last_time") / 5).alias("text"))


def _bytes(x):
    return f"""CASE WHEN abs({x}) >= 1048576 THEN printf('%.2f MB', abs({x}) / 1048576)
      WHEN abs({x}) >= 1024 THEN printf('%.1f KB', abs({x}) / 1024) ELSE floor(abs({x}) + 0.5)::BIGINT || ' B' END"""


@query(
    "format_bytes",
    f"""SELECT id, {_bytes('x')} AS plain, CASE WHEN y > 0 THEN '+' WHEN y < 0 THEN '-' ELSE '' END || {_bytes('y')} AS signed
    FROM (SELECT id, (strlen(content) * 97)::DOUBLE AS x, (strlen(content) * 97 - 200000)::DOUBLE AS y FROM exports)""",
    ("exports",),
)
def format_bytes(spark, d):
    size = (F.octet_length("content") * 97).cast("double")
    return V.exports(spark, d).select(
        "id", N.format_bytes(size).alias("plain"), N.format_bytes(size - 200000, signed=True).alias("signed")
    )


@query(
    "format_memory",
    """SELECT name, phase, CASE WHEN memory IS NULL THEN '--' WHEN memory >= 1024 THEN printf('%.1f MB', memory / 1024)
      ELSE printf('%.0f KB', memory) END AS plain,
      CASE WHEN memory IS NULL THEN '--' ELSE CASE WHEN y > 0 THEN '+' WHEN y < 0 THEN '-' ELSE '' END ||
        CASE WHEN abs(y) >= 1024 THEN printf('%.1f MB', abs(y) / 1024) ELSE printf('%.0f KB', abs(y)) END END AS signed
    FROM (SELECT *, memory - 30000 AS y FROM metric_counters)""",
    ("metric_counters",),
)
def format_memory(spark, d):
    return V.metric_counters(spark, d).select(
        "name",
        "phase",
        N.format_memory(F.col("memory")).alias("plain"),
        N.format_memory(F.col("memory") - 30000, signed=True).alias("signed"),
    )
