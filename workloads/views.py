"""Telemetry-shaped views over the driver's tables, once for Spark and once as SQL.

Every view is a projection or a hash aggregation of a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.plans.spread import portions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch_us(col: str):
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def samples(spark, d, events=None):
    """Capture samples: one per event, session = user, some counters unreadable."""
    return (table(spark, d, "events") if events is None else events).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("sample_id"),
        epoch_us("ts").alias("ts_us"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("last_time"),
        (F.col("value") * 0.75 + (F.col("event_id") % 8) * 0.125).alias("recent_average"),
        (2 * F.col("value") + 5).alias("overall_last"),
        (4 * F.col("value") + 20).alias("application_last"),
        F.when(F.col("event_id") % 50 != 0, F.col("value") * 0.02).alias("self_overhead"),
    )


SAMPLES = """
samples AS (
  SELECT user_id AS session_id, event_id AS sample_id, epoch_us(ts) AS ts_us,
         CASE WHEN event_id % 97 <> 0 THEN value END AS last_time,
         value * 0.75 + (event_id % 8) * 0.125 AS recent_average,
         2 * value + 5 AS overall_last, 4 * value + 20 AS application_last,
         CASE WHEN event_id % 50 <> 0 THEN value * 0.02 END AS self_overhead
  FROM events)"""

METRICS = (
    "session_average recent_average encounter_average last_time peak_time "
    "over1 over5 over10 over50 over100 over500 over1000"
).split()


def metric_counters(spark, d):
    """The 12 profiler counters and memory per client, addon and capture phase."""
    e = table(spark, d, "events")
    phased = e.withColumn(
        "phase",
        F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit("initial"), F.lit("final"))).otherwise(F.array(F.lit("final")))),
    )
    cents = F.col("value").cast("decimal(18,2)")
    u = F.col("user_id")
    mean = lambda cond: F.sum(F.when(cond, cents)).cast("double") / F.count_if(cond)
    # Cut, not rounded: both engines agree on every digit.
    cut = lambda c: F.floor(c * 1000000.0) / 1000000.0
    over = lambda k: F.count_if(F.col("value") > k).cast("double")
    g = phased.groupBy("user_id", "phase").agg(
        (mean(F.lit(True)) / 12).alias("session_average"),
        (mean(F.col("event_type") == "click") / 12).alias("_click"),
        (mean(F.col("event_type") == "purchase") / 6).alias("encounter_average"),
        F.max_by("value", "event_id").alias("last_time"),
        F.max("value").alias("peak_time"),
        *[over(k).alias(f"over{k}") for k in (1, 5, 10, 50, 100)],
        F.count_if(F.col("value") * 2 > 250).cast("double").alias("_o500"),
        F.count_if(F.col("value") * 4 > 1000).cast("double").alias("_o1000"),
        F.sum(F.col("event_id") % 1000).cast("double").alias("memory"),
    )
    return g.select(
        (u % 10).alias("client_id"),
        u.alias("session_id"),
        F.concat(F.lit("Addon"), u.cast("string")).alias("name"),
        F.when(u % 6 != 0, F.concat(F.lit("Title "), (u % 13).cast("string"))).alias("title"),
        (u % 11 != 0).alias("loaded"),
        "phase",
        cut(F.col("session_average")).alias("session_average"),
        cut(F.col("_click") * (u % 3)).alias("recent_average"),
        cut(F.col("encounter_average")).alias("encounter_average"),
        "last_time",
        "peak_time",
        "over1",
        "over5",
        "over10",
        F.when(u % 7 > 0, F.col("over50")).otherwise(0.0).alias("over50"),
        F.when(u % 5 > 0, F.col("over100")).otherwise(0.0).alias("over100"),
        F.when(u % 4 < 3, F.col("_o500")).otherwise(0.0).alias("over500"),
        F.when(u % 2 == 0, F.col("_o1000")).otherwise(0.0).alias("over1000"),
        F.when(u % 9 != 0, F.col("memory")).alias("memory"),
    )


METRIC_COUNTERS = """
counters0 AS (
  SELECT user_id AS u, phase,
    sum(value::DECIMAL(18,2))::DOUBLE / count(*) / 12 AS sa,
    sum(CASE WHEN event_type = 'click' THEN value::DECIMAL(18,2) END)::DOUBLE
      / nullif(count(*) FILTER (event_type = 'click'), 0) / 12 AS click,
    sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,2) END)::DOUBLE
      / nullif(count(*) FILTER (event_type = 'purchase'), 0) / 6 AS ea,
    arg_max(value, event_id) AS last_time, max(value) AS peak_time,
    count(*) FILTER (value > 1)::DOUBLE AS over1, count(*) FILTER (value > 5)::DOUBLE AS over5,
    count(*) FILTER (value > 10)::DOUBLE AS over10, count(*) FILTER (value > 50)::DOUBLE AS over50,
    count(*) FILTER (value > 100)::DOUBLE AS over100, count(*) FILTER (value * 2 > 250)::DOUBLE AS o500,
    count(*) FILTER (value * 4 > 1000)::DOUBLE AS o1000, sum(event_id % 1000)::DOUBLE AS memory
  FROM (SELECT *, 'final' AS phase FROM events
        UNION ALL SELECT *, 'initial' AS phase FROM events WHERE event_id % 3 = 0)
  GROUP BY user_id, phase),
metric_counters AS (
  SELECT u % 10 AS client_id, u AS session_id, 'Addon' || u AS name,
    CASE WHEN u % 6 <> 0 THEN 'Title ' || (u % 13) END AS title, u % 11 <> 0 AS loaded, phase,
    floor(sa * 1000000::DOUBLE) / 1000000::DOUBLE AS session_average,
    floor(click * (u % 3) * 1000000::DOUBLE) / 1000000::DOUBLE AS recent_average,
    floor(ea * 1000000::DOUBLE) / 1000000::DOUBLE AS encounter_average, last_time, peak_time, over1, over5, over10,
    CASE WHEN u % 7 > 0 THEN over50 ELSE 0 END AS over50,
    CASE WHEN u % 5 > 0 THEN over100 ELSE 0 END AS over100,
    CASE WHEN u % 4 < 3 THEN o500 ELSE 0 END AS over500,
    CASE WHEN u % 2 = 0 THEN o1000 ELSE 0 END AS over1000,
    CASE WHEN u % 9 <> 0 THEN memory END AS memory
  FROM counters0)"""


def object_snapshots(spark, d):
    """Object snapshots: supplier = session, part = object, ship year = snapshot."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("session_id"),
        F.year("l_shipdate").cast("bigint").alias("snap_no"),
        F.col("l_partkey").alias("object_id"),
        "l_quantity",
        "l_extendedprice",
    )
    li = portions(lines, "session_id", "snap_no", "object_id").groupBy("session_id", "snap_no", "object_id").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )
    k = F.col("p_partkey")
    # Texts are made once per part, not once per row of the join.
    part = table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("root.children["), k.cast("string"), F.lit("]")).alias("path"),
        F.when(k % 23 != 0, F.col("p_type")).alias("object_type"),
        F.concat(F.lit("Interface/AddOns/"), F.regexp_replace("p_brand", "#", ""), F.lit("/f.lua:"), k.cast("string")).alias("location"),
    )
    return li.join(part, li.object_id == part.p_partkey).select(
        "session_id",
        "snap_no",
        "object_id",
        "path",
        "object_type",
        "location",
        (F.col("q") % 2 == 0).alias("shown"),
        (F.col("q") % 3 == 0).alias("on_update"),
        F.when(F.col("object_id") % 29 != 0, F.col("price")).alias("self_time"),
        F.when(F.col("object_id") % 31 != 0, F.col("n") * 10 + F.col("q")).alias("self_calls"),
    )


OBJECT_SNAPSHOTS = """
object_snapshots AS (
  SELECT session_id, snap_no, object_id, 'root.children[' || object_id || ']' AS path,
    CASE WHEN object_id % 23 <> 0 THEN p_type END AS object_type,
    'Interface/AddOns/' || replace(p_brand, '#', '') || '/f.lua:' || object_id AS location,
    q % 2 = 0 AS shown, q % 3 = 0 AS on_update,
    CASE WHEN object_id % 29 <> 0 THEN price END AS self_time,
    CASE WHEN object_id % 31 <> 0 THEN n * 10 + q END AS self_calls
  FROM (SELECT l_suppkey AS session_id, year(l_shipdate) AS snap_no, l_partkey AS object_id,
          sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS n,
          sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price
        FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = object_id)"""


def pool_snapshots(spark, d):
    """Pool snapshots: order month = snapshot, active = orders, capacity at times unknown."""
    o = table(spark, d, "orders")
    g = o.groupBy(
        (F.col("o_custkey") % 10).alias("session_id"),
        (F.col("o_custkey") % 50).alias("pool_id"),
        (F.year("o_orderdate").cast("bigint") * 12 + F.month("o_orderdate")).alias("snap_no"),
    ).agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.select(
        "session_id",
        "pool_id",
        F.concat(F.lit("Mod.pools."), F.col("pool_id").cast("string")).alias("path"),
        "snap_no",
        "active",
        F.when((F.col("snap_no") + F.col("pool_id")) % 11 != 0, F.col("active") + F.col("f")).alias("capacity"),
    )


POOL_SNAPSHOTS = """
pool_snapshots AS (
  SELECT session_id, pool_id, 'Mod.pools.' || pool_id AS path, snap_no, active,
    CASE WHEN (snap_no + pool_id) % 11 <> 0 THEN active + f END AS capacity
  FROM (SELECT o_custkey % 10 AS session_id, o_custkey % 50 AS pool_id,
          year(o_orderdate) * 12 + month(o_orderdate) AS snap_no, count(*) AS active,
          count(*) FILTER (o_orderstatus = 'F') AS f
        FROM orders GROUP BY ALL))"""


def function_snapshots(spark, d):
    """Function snapshots: one reference per order line; a function can sit on several paths."""
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("session_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("snap_no"),
        F.concat(F.lit("Mod"), F.col("l_suppkey").cast("string"), F.lit(".f"), F.col("l_linenumber").cast("string")).alias("path"),
        (F.col("l_partkey") % 200).alias("fn_id"),
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_extendedprice")).alias("self_time"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") + F.col("l_quantity")).alias("inclusive_time"),
        F.col("l_quantity").cast("bigint").alias("calls"),
    )


FUNCTION_SNAPSHOTS = """
function_snapshots AS (
  SELECT l_suppkey % 4 AS session_id, l_orderkey * 8 + l_linenumber AS snap_no,
    'Mod' || l_suppkey || '.f' || l_linenumber AS path, l_partkey % 200 AS fn_id,
    CASE WHEN l_partkey % 19 <> 0 THEN l_extendedprice END AS self_time,
    CASE WHEN l_tax > 0 THEN l_extendedprice + l_quantity END AS inclusive_time,
    l_quantity::BIGINT AS calls
  FROM lineitem)"""


def storage_roots(spark, d):
    """Persistent roots before and after: one root per document source and batch."""
    docs = table(spark, d, "documents")
    phased = docs.withColumn(
        "phase",
        F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("initial"), F.lit("final"))).otherwise(F.array(F.lit("final")))),
    )
    return phased.groupBy(F.expr("doc_id div 20 % 5").alias("session_id"), F.col("source").alias("name"), "phase").agg(
        (F.lit(48) + F.sum(F.octet_length("text") + 16)).cast("bigint").alias("bytes"),
        F.count_distinct((F.col("doc_id") % 7)).alias("tables"),
        F.count(F.lit(1)).alias("entries"),
    )


STORAGE_ROOTS = """
storage_roots AS (
  SELECT doc_id // 20 % 5 AS session_id, source AS name, phase, (48 + sum(strlen(text) + 16))::BIGINT AS bytes,
    count(DISTINCT doc_id % 7) AS tables, count(*) AS entries
  FROM (SELECT *, 'final' AS phase FROM documents
        UNION ALL SELECT *, 'initial' AS phase FROM documents WHERE doc_id % 3 = 0)
  GROUP BY ALL)"""


def catalog(spark, d):
    """Event catalog per build."""
    return table(spark, d, "part").groupBy(
        (F.col("p_size") % 3).cast("bigint").alias("build"),
        F.upper(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.regexp_replace("p_brand", "#", ""))).alias("event_name"),
    ).agg(F.min(F.when(F.col("p_type") != "SMALL", F.lower("p_type"))).alias("sig")).select(
        "build", "event_name", F.coalesce("sig", F.lit("")).alias("signature")
    )


CATALOG = """
catalog AS (
  SELECT p_size % 3 AS build, upper(replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '')) AS event_name,
    coalesce(min(CASE WHEN p_type <> 'SMALL' THEN lower(p_type) END), '') AS signature
  FROM part GROUP BY ALL)"""


def event_records(spark, d, events=None):
    """Raw event records; arguments are typed values."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint")
    arg = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("text"))
    numbers = F.transform(
        F.sequence(F.lit(1), (F.col("event_id") % 20).cast("int") + 1),
        lambda i: F.struct(F.lit("number").alias("type"), (F.col("event_id") % 10 + i).cast("string").alias("text")),
    )
    return (table(spark, d, "events") if events is None else events).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        epoch_us("ts").alias("ts_us"),
        F.when(F.col("event_id") % 101 != 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event"),
        F.concat(
            F.array(
                arg("string", F.concat(F.lit('t"'), F.col("event_type"))),
                arg("number", k),
                F.struct(F.lit("boolean").alias("type"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false").alias("text")),
                F.struct(F.when(F.col("event_id") % 5 == 0, "table").when(F.col("event_id") % 5 == 1, "secret").when(F.col("event_id") % 5 == 2, "userdata").otherwise("nil").alias("type"), F.lit("").alias("text")),
            ),
            numbers,
        ).alias("args"),
    )


EVENT_RECORDS = """
event_records AS (
  SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) AS ts_us,
    CASE WHEN event_id % 101 <> 0 THEN upper(event_type) ELSE event_type END AS event,
    ['"t\\"' || event_type || '"', regexp_extract(props, '"k": ([0-9]+)', 1),
     CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,
     CASE event_id % 5 WHEN 0 THEN '<table>' WHEN 1 THEN '<secret>' WHEN 2 THEN '<userdata>' ELSE 'nil' END]
    || list_transform(range(1, event_id % 20 + 2), lambda i: (event_id % 10 + i)::VARCHAR) AS shown
  FROM events)"""


def errors(spark, d, events=None):
    """Captured errors."""
    e = (table(spark, d, "events") if events is None else events).filter(F.col("event_type") == "error")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000000").alias("time"),
        F.when(F.col("event_id") % 41 != 0, (u % 10).cast("string")).otherwise("n/a").alias("session"),
        F.when(F.col("event_id") % 4 != 0, F.lit(1) + F.col("event_id") % 3).alias("counter"),
        F.concat(F.lit("Mod"), (u % 7).cast("string"), F.lit(" failed: "), F.col("props")).alias("message"),
        F.when(
            F.col("event_id") % 13 != 0,
            F.concat(F.lit("Interface\\AddOns\\Mod"), (u % 7).cast("string"), F.lit("\\Core.lua:"), (F.col("event_id") % 100).cast("string")),
        ).alias("stack"),
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("value = "), F.col("event_id").cast("string"))).alias("locals"),
        F.when(F.col("event_id") % 17 == 0, F.lit("Given")).alias("source"),
    )


ERRORS = """
errors AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000000 AS time,
    CASE WHEN event_id % 41 <> 0 THEN (user_id % 10)::VARCHAR ELSE 'n/a' END AS session,
    CASE WHEN event_id % 4 <> 0 THEN 1 + event_id % 3 END AS counter,
    'Mod' || (user_id % 7) || ' failed: ' || props AS message,
    CASE WHEN event_id % 13 <> 0 THEN 'Interface\\AddOns\\Mod' || (user_id % 7) || '\\Core.lua:' || (event_id % 100) END AS stack,
    CASE WHEN event_id % 6 = 0 THEN 'value = ' || event_id END AS locals,
    CASE WHEN event_id % 17 = 0 THEN 'Given' END AS source
  FROM events WHERE event_type = 'error')"""


def exports(spark, d):
    """Flat evidence exports as clients hand them in: one per document; twenty documents share a second."""
    kinds = F.array(*[F.lit(k) for k in ("run_result", "error_log", "performance_capture", "event_log", "other")])
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("account"),
        (F.lit(1700000000) + F.expr("doc_id div 20") * 60).alias("created_at"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("Report "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Root."), F.col("lang"))).alias("path"),
        F.when(F.col("doc_id") % 37 != 0, F.col("text")).otherwise("").alias("content"),
        F.col("lang").alias("locale"),
    )


EXPORTS = """
exports AS (
  SELECT doc_id AS id, source AS account, 1700000000 + doc_id // 20 * 60 AS created_at,
    ['run_result', 'error_log', 'performance_capture', 'event_log', 'other'][doc_id % 5 + 1] AS kind,
    'Report ' || doc_id AS title, CASE WHEN doc_id % 3 <> 0 THEN 'Root.' || lang END AS path,
    CASE WHEN doc_id % 37 <> 0 THEN text ELSE '' END AS content, lang AS locale
  FROM documents)"""


def nodes(spark, d):
    """A document tree: every part hangs below part (key - 1) div 4, part 0 is the root."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"),
        F.when(k > 0, F.expr("(p_partkey - 1) div 4")).alias("parent_id"),
        F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), k.cast("string"))).alias("key"),
        F.when(k % 11 == 0, "function").when(k % 4 == 1, "string").when(k % 4 == 2, "number").otherwise("table").alias("kind"),
        F.col("p_brand").alias("value"),
    )


NODES = """
nodes AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 4 END AS parent_id,
    CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS key,
    CASE WHEN p_partkey % 11 = 0 THEN 'function' WHEN p_partkey % 4 = 1 THEN 'string'
         WHEN p_partkey % 4 = 2 THEN 'number' ELSE 'table' END AS kind, p_brand AS value
  FROM part)"""


def edges(spark, d):
    """Reference graph: tree edges plus back edges, so there are cycles."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    tree = p.filter("k > 0").select(F.expr("(k - 1) div 4").alias("src"), F.col("k").alias("dst"))
    back = p.filter("k % 97 = 0").select(F.col("k").alias("src"), (F.col("k") % 50).alias("dst"))
    return tree.unionByName(back)


EDGES = """
edges AS (
  SELECT (p_partkey - 1) // 4 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, p_partkey % 50 FROM part WHERE p_partkey % 97 = 0)"""


def history(spark, d):
    """Run history entries."""
    return table(spark, d, "conversations").select(
        (F.col("conv_id") % 5).alias("account"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat(F.when(F.col("conv_id") % 3 == 0, "  /run ").when(F.col("conv_id") % 3 == 1, "/Script  ").otherwise(" "), F.col("text"), F.lit(" \n")).alias("code"),
        F.col("text").alias("result"),
        F.when(F.col("turn") % 5 != 4, F.when(F.col("role") == "assistant", "true").otherwise("false")).alias("succeeded"),
        F.when(F.col("turn") % 3 != 2, (F.lit(1700000000) + F.col("conv_id") * 60 + F.col("turn")).cast("string")).otherwise("bad").alias("timestamp"),
    )


HISTORY = """
history AS (
  SELECT conv_id % 5 AS account, conv_id * 1000 + turn AS seq,
    CASE conv_id % 3 WHEN 0 THEN '  /run ' WHEN 1 THEN '/Script  ' ELSE ' ' END || text || ' ' || chr(10) AS code,
    text AS result,
    CASE WHEN turn % 5 <> 4 THEN CASE WHEN role = 'assistant' THEN 'true' ELSE 'false' END END AS succeeded,
    CASE WHEN turn % 3 <> 2 THEN (1700000000 + conv_id * 60 + turn)::VARCHAR ELSE 'bad' END AS timestamp
  FROM conversations)"""


def source_files(spark, d):
    """A source corpus: one file per page, build = page modulo 3; a tag per line."""
    return table(spark, d, "pages").select(
        (F.col("page_id") % 3).alias("build"),
        F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 == 0, ".xml").otherwise(".lua")).alias("file"),
        F.regexp_replace("html", "><", ">\n<").alias("text"),
    )


SOURCE_FILES = """
source_files AS (
  SELECT page_id % 3 AS build, 'src/' || page_id || CASE WHEN page_id % 7 = 0 THEN '.xml' ELSE '.lua' END AS file,
    replace(html, '><', '>' || chr(10) || '<') AS text
  FROM pages)"""


def benchmark_samples(spark, d):
    """Function benchmark calls, one run per event type."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("iteration"),
        F.when(F.col("event_id") % 89 != 0, F.col("value")).alias("elapsed"),
        (F.col("event_id") % 4096).alias("allocated"),
        (F.col("event_id") % 1024).alias("deallocated"),
    )


BENCHMARK_SAMPLES = """
benchmark_samples AS (
  SELECT event_type AS run_id, event_id AS iteration, CASE WHEN event_id % 89 <> 0 THEN value END AS elapsed,
    event_id % 4096 AS allocated, event_id % 1024 AS deallocated
  FROM events)"""


def labels(spark, d):
    """Interface labels of two locales."""
    return table(spark, d, "part").groupBy(
        F.when(F.col("p_size") % 2 == 0, "base").otherwise("enUS").alias("locale"),
        F.concat_ws(" ", "p_name", "p_brand").alias("key"),
    ).agg(F.min("p_type").alias("t"), F.max("p_size").alias("s")).select(
        "locale", "key",
        F.concat("t", F.when(F.col("s") % 3 == 0, " %d").when(F.col("s") % 3 == 1, " %s").otherwise(""), F.when(F.col("s") % 11 == 0, "é").otherwise("")).alias("value"),
    )


LABELS = """
labels_ AS (
  SELECT locale, key, t || CASE s % 3 WHEN 0 THEN ' %d' WHEN 1 THEN ' %s' ELSE '' END
    || CASE WHEN s % 11 = 0 THEN 'é' ELSE '' END AS value
  FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'base' ELSE 'enUS' END AS locale, p_name || ' ' || p_brand AS key,
          min(p_type) AS t, max(p_size) AS s FROM part GROUP BY ALL))"""


def manifest(spark, d):
    """Ordered file lists per build; build 0 differs where the supplier key is a multiple of 30."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    b, o = (F.col("k") % 3).cast("string"), F.expr("k div 3")
    return s.select(
        (F.col("k") % 3).alias("build"),
        o.alias("ord"),
        F.when(F.col("k") % 30 == 0, F.concat(F.lit("x"), o.cast("string")))
        .when(o == 0, F.concat(F.lit("Core/Clients/c"), b, F.lit(".lua")))
        .when(o == 1, "Core/Compatibility.lua")
        .when(o == 2, F.concat(F.lit("Modules/Events/CatalogData_c"), b, F.lit(".lua")))
        .otherwise(F.concat(F.lit("f"), o.cast("string"), F.lit(".lua"))).alias("path"),
    )


MANIFEST = """
manifest AS (
  SELECT s_suppkey % 3 AS build, s_suppkey // 3 AS ord,
    CASE WHEN s_suppkey % 30 = 0 THEN 'x' || (s_suppkey // 3)
         WHEN s_suppkey // 3 = 0 THEN 'Core/Clients/c' || (s_suppkey % 3) || '.lua'
         WHEN s_suppkey // 3 = 1 THEN 'Core/Compatibility.lua'
         WHEN s_suppkey // 3 = 2 THEN 'Modules/Events/CatalogData_c' || (s_suppkey % 3) || '.lua'
         ELSE 'f' || (s_suppkey // 3) || '.lua' END AS path
  FROM supplier)"""


SQL = {
    "samples": SAMPLES,
    "metric_counters": METRIC_COUNTERS,
    "object_snapshots": OBJECT_SNAPSHOTS,
    "pool_snapshots": POOL_SNAPSHOTS,
    "function_snapshots": FUNCTION_SNAPSHOTS,
    "storage_roots": STORAGE_ROOTS,
    "catalog": CATALOG,
    "event_records": EVENT_RECORDS,
    "errors": ERRORS,
    "exports": EXPORTS,
    "nodes": NODES,
    "edges": EDGES,
    "history": HISTORY,
    "source_files": SOURCE_FILES,
    "benchmark_samples": BENCHMARK_SAMPLES,
    "labels": LABELS,
    "manifest": MANIFEST,
}


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the views it reads; it may add more after a leading ``WITH``."""
    if not uses:
        return sql.strip()
    heads = ",".join(SQL[name] for name in uses).strip()
    body = sql.strip()
    if body.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},{body[len('WITH RECURSIVE'):]}"
    if body.startswith("WITH"):
        return f"WITH {heads},{body[len('WITH'):]}"
    return f"WITH {heads}\n{body}"
