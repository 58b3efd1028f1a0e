"""Captured errors and source attribution."""

from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.operators import errors as R
from workloads import views as V
from workloads.registry import query

SOURCE = """coalesce(nullif(source, ''), nullif(regexp_extract(replace(coalesce(message, '') || chr(10) || coalesce(stack, ''), '\\', '/'),
  '[Aa]dd[Oo]ns/([^/\\s]+)', 1), ''), 'unknown')"""


@query("errors_scan", "SELECT seq, message, session FROM errors", ("errors",))
def errors_scan(spark, d):
    return R.errors_scan(V.errors(spark, d)).select("seq", "message", "session")


@query("errors_scope", "SELECT seq, session FROM errors WHERE TRY_CAST(session AS BIGINT) = 3", ("errors",))
def errors_scope(spark, d):
    return R.errors_scope(V.errors(spark, d), "current", 3).select("seq", "session")


@query(
    "errors_search",
    "SELECT seq FROM errors WHERE contains(lower(concat_ws(chr(10), coalesce(message, ''), coalesce(stack, ''), coalesce(source, ''))), 'mod3\\core')",
    ("errors",),
)
def errors_search(spark, d):
    return R.errors_search(V.errors(spark, d), "  Mod3\\CORE ").select("seq")


@query("error_source", f"SELECT seq, {SOURCE} AS source FROM errors", ("errors",))
def error_source(spark, d):
    return V.errors(spark, d).select("seq", R.error_source().alias("source"))


@query(
    "error_occurrences",
    """SELECT coalesce(message, '') AS message, coalesce(stack, '') AS stack, sum(coalesce(counter, 1))::BIGINT AS occurrences,
      min(time) AS first_time, max(time) AS last_time, max(seq) AS latest_seq,
      sha256(coalesce(message, '') || chr(10) || coalesce(stack, '')) AS signature
    FROM errors GROUP BY ALL""",
    ("errors",),
)
def error_occurrences(spark, d):
    return R.error_occurrences(V.errors(spark, d))


@query(
    "error_report",
    f"""SELECT seq, concat_ws(chr(10), 'Lua Error Report', '', 'Context',
      'Time: ' || strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S'), 'Source: ' || {SOURCE},
      'Occurrences: ' || coalesce(counter, 1), 'Capture session: ' || coalesce(TRY_CAST(session AS BIGINT), -1), '',
      'Client Environment', 'Version: 1.2.3', 'Build: 77 (Jan 1 2024)', 'Locale: enUS', '', 'Error', message, '', 'Stack Trace',
      coalesce(stack, 'Not available'),
      CASE WHEN locals IS NOT NULL THEN chr(10) || 'Locals' || chr(10) || locals END) AS report
    FROM errors""",
    ("errors",),
)
def error_report(spark, d):
    return V.errors(spark, d).select("seq", R.error_report("1.2.3", "77", "Jan 1 2024", "enUS").alias("report"))


@query(
    "source_attribution",
    """WITH l AS (SELECT session_id, snap_no, object_id, CASE object_id % 4 WHEN 0 THEN 'interface\\addons\\Deep\\sub\\x.lua:' || object_id
        WHEN 1 THEN location WHEN 2 THEN '*/Blizzard_UI/a.lua' ELSE 'code' || object_id END AS location FROM object_snapshots)
    SELECT session_id, snap_no, object_id,
      CASE object_id % 4 WHEN 0 THEN 'Deep' WHEN 1 THEN split_part(location, '/', 3) WHEN 2 THEN 'Blizzard' ELSE 'unknown' END AS source,
      CASE object_id % 4 WHEN 0 THEN 'sub\\x.lua:' || object_id WHEN 1 THEN split_part(location, '/', 4)
        ELSE replace(location, '/', '\\') END AS source_file
    FROM l""",
    ("object_snapshots",),
)
def source_attribution(spark, d):
    k = F.col("object_id")
    location = (
        F.when(k % 4 == 0, F.concat(F.lit("interface\\addons\\Deep\\sub\\x.lua:"), k.cast("string")))
        .when(k % 4 == 1, F.col("location"))
        .when(k % 4 == 2, "*/Blizzard_UI/a.lua")
        .otherwise(F.concat(F.lit("code"), k.cast("string")))
    )
    found = V.object_snapshots(spark, d).select("session_id", "snap_no", "object_id", T.source_attribution(location).alias("s"))
    return found.select("session_id", "snap_no", "object_id", "s.source", "s.source_file")
