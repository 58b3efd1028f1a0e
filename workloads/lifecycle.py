"""Objects, pools, functions and storage between snapshots."""

from pyspark.sql import functions as F

from fieldscope.operators import capture as C
from fieldscope.operators import lifecycle as L
from fieldscope.operators.reports import report_heads
from workloads import views as V
from workloads.registry import query


LIFECYCLE = """
lifecycle AS (
  WITH o AS (SELECT *, lag(shown) OVER w AS was, row_number() OVER w AS rn,
               max(shown::INT) OVER (PARTITION BY session_id, object_id ORDER BY snap_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever,
               min(snap_no) OVER (PARTITION BY session_id) AS base
             FROM object_snapshots WINDOW w AS (PARTITION BY session_id, object_id ORDER BY snap_no)),
  n AS (SELECT session_id, snap_no, count(*) AS n FROM object_snapshots GROUP BY ALL),
  c AS (SELECT session_id, arg_min(n, snap_no) AS initial_objects, arg_max(n, snap_no) AS final_objects,
          max(n) AS peak_objects FROM n GROUP BY session_id)
  SELECT session_id, any_value(initial_objects) AS initial_objects, any_value(final_objects) AS final_objects,
    any_value(peak_objects) AS peak_objects, count(*) FILTER (rn = 1 AND snap_no > base) AS newly_observed,
    count(*) FILTER (shown AND NOT was) AS activations,
    count(*) FILTER (shown AND NOT was AND ever = 1) AS reused_activations,
    count(*) FILTER (NOT shown AND was) AS hidden_transitions,
    count(*) FILTER (shown AND NOT was AND ever = 1) / nullif(count(*) FILTER (shown AND NOT was), 0) * 100 AS reuse_rate
  FROM o JOIN c USING (session_id) GROUP BY session_id)"""


@query("object_lifecycle", f"WITH {LIFECYCLE} SELECT * FROM lifecycle", ("object_snapshots",))
def object_lifecycle(spark, d):
    return L.object_lifecycle(V.object_snapshots(spark, d))


POOLS = """
pools AS (
  WITH p AS (SELECT *, active - lag(active) OVER w AS change,
        first_value(capacity) OVER w AS c0, last_value(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c1,
        first_value(active) OVER w AS a0, last_value(active) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a1
      FROM pool_snapshots WINDOW w AS (PARTITION BY session_id, pool_id ORDER BY snap_no))
  SELECT session_id, pool_id, any_value(path) AS path, max(a0) AS initial_active, max(active) AS peak_active,
      max(a1) AS final_active, max(c0) AS initial_capacity, coalesce(max(c1), max(c0)) AS final_capacity,
      sum(greatest(0, coalesce(change, 0)))::BIGINT AS acquisitions, sum(greatest(0, -coalesce(change, 0)))::BIGINT AS releases,
      sum(CASE WHEN change > 0 AND (capacity IS NULL OR c0 IS NULL OR capacity <= c0) THEN change ELSE 0 END)::BIGINT AS reuse_acquisitions,
      sum(CASE WHEN change > 0 AND (capacity IS NULL OR c0 IS NULL OR capacity <= c0) THEN change ELSE 0 END)
        / nullif(sum(greatest(0, coalesce(change, 0))), 0) * 100 AS reuse_rate
  FROM p GROUP BY session_id, pool_id)"""


@query("pool_activity", f"WITH {POOLS} SELECT * FROM pools", ("pool_snapshots",))
def pool_activity(spark, d):
    return L.pool_activity(V.pool_snapshots(spark, d))


CHURN = """churn AS (
  SELECT session_id, path, count(*) FILTER (fn_id <> prev) AS replacements
  FROM (SELECT *, lag(fn_id) OVER (PARTITION BY session_id, path ORDER BY snap_no, fn_id) AS prev FROM function_snapshots)
  GROUP BY session_id, path HAVING replacements > 0)"""


@query("function_churn", f"WITH {CHURN} SELECT * FROM churn", ("function_snapshots",))
def function_churn(spark, d):
    return L.function_churn(V.function_snapshots(spark, d))


NEW_FUNCTIONS = """
new_functions AS (
  WITH s AS (SELECT session_id, snap_no // 8000 AS snap, fn_id FROM function_snapshots),
    b AS (SELECT session_id, min(snap) AS base FROM s GROUP BY 1),
    f AS (SELECT session_id, fn_id, min(snap) AS first FROM s GROUP BY 1, 2),
    k AS (SELECT session_id, snap, count(DISTINCT fn_id) AS fns, count(*) AS refs FROM s GROUP BY 1, 2),
    p AS (SELECT session_id, max(fns) AS functions_discovered, max(refs) AS function_references FROM k GROUP BY 1)
  SELECT session_id, any_value(functions_discovered) AS functions_discovered,
      any_value(function_references) AS function_references, count(*) FILTER (first > base) AS new_function_instances
  FROM f JOIN b USING (session_id) JOIN p USING (session_id) GROUP BY session_id)"""


@query("new_functions", f"WITH {NEW_FUNCTIONS} SELECT * FROM new_functions", ("function_snapshots",))
def new_functions(spark, d):
    coarse = V.function_snapshots(spark, d).withColumn("snap_no", F.expr("snap_no div 8000"))
    return L.new_functions(coarse)


@query(
    "function_registry",
    """SELECT session_id, fn_id, count(*) AS "references", min(path) AS first_path, count(DISTINCT path) AS path_count,
      array_to_string(list_sort(list_distinct(list(path))), '|') AS paths
    FROM function_snapshots GROUP BY session_id, fn_id""",
    ("function_snapshots",),
)
def function_registry(spark, d):
    return L.function_registry(V.function_snapshots(spark, d)).withColumn("paths", F.array_join("paths", "|"))


HOT_FUNCTIONS = """
hot_functions AS (
  WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id, fn_id ORDER BY snap_no, path, self_time NULLS FIRST) AS up,
               row_number() OVER (PARTITION BY session_id, fn_id ORDER BY snap_no DESC, path DESC, self_time DESC NULLS LAST) AS down,
               count(*) OVER (PARTITION BY session_id, fn_id) AS observations
             FROM function_snapshots),
  e AS (SELECT b.session_id, b.fn_id, b.path, greatest(0, b.self_time - a.self_time) AS elapsed,
          CASE WHEN a.inclusive_time IS NOT NULL AND b.inclusive_time IS NOT NULL THEN greatest(0, b.inclusive_time - a.inclusive_time) END AS inclusive,
          greatest(0, coalesce(b.calls, 0) - coalesce(a.calls, 0)) AS calls, b.observations
        FROM o a JOIN o b ON a.session_id = b.session_id AND a.fn_id = b.fn_id AND a.up = 1 AND b.down = 1
        WHERE a.self_time IS NOT NULL AND b.self_time IS NOT NULL)
  SELECT *, CASE WHEN calls > 0 THEN elapsed / calls END AS average,
    row_number() OVER (PARTITION BY session_id ORDER BY elapsed DESC, calls DESC, fn_id) AS rank
  FROM e WHERE elapsed > 0 OR calls > 0 QUALIFY rank <= 80)"""


@query("hot_functions", f"WITH {HOT_FUNCTIONS} SELECT * FROM hot_functions", ("function_snapshots",))
def hot_functions(spark, d):
    return L.hot_functions(V.function_snapshots(spark, d))


HOT_OBJECTS = """
hot_objects AS (
  WITH s AS (SELECT *, min(snap_no) OVER w AS lo, max(snap_no) OVER w AS hi FROM object_snapshots WINDOW w AS (PARTITION BY session_id)),
  e AS (SELECT b.session_id, b.object_id, b.path, greatest(0, b.self_time - a.self_time) AS elapsed,
          greatest(0, coalesce(b.self_calls, 0) - coalesce(a.self_calls, 0)) AS calls
        FROM s a JOIN s b USING (session_id, object_id)
        WHERE a.snap_no = a.lo AND b.snap_no = b.hi AND a.self_time IS NOT NULL AND b.self_time IS NOT NULL)
  SELECT *, CASE WHEN calls > 0 THEN elapsed / calls END AS average,
    row_number() OVER (PARTITION BY session_id ORDER BY elapsed DESC, object_id) AS rank
  FROM e WHERE elapsed > 0 OR calls > 0 QUALIFY rank <= 50)"""


@query("hot_objects", f"WITH {HOT_OBJECTS} SELECT * FROM hot_objects", ("object_snapshots",))
def hot_objects(spark, d):
    return L.hot_objects(V.object_snapshots(spark, d))


@query(
    "object_totals",
    """SELECT session_id, snap_no, count(*) AS objects, count(*) FILTER (shown) AS visible,
      count(*) FILTER (on_update) AS on_update FROM object_snapshots GROUP BY session_id, snap_no""",
    ("object_snapshots",),
)
def object_totals(spark, d):
    return L.object_totals(V.object_snapshots(spark, d))


@query(
    "counts_by_type",
    """SELECT session_id, snap_no, coalesce(object_type, 'unknown') AS object_type, count(*) AS objects
    FROM object_snapshots GROUP BY ALL""",
    ("object_snapshots",),
)
def counts_by_type(spark, d):
    return L.counts_by_type(V.object_snapshots(spark, d))


@query(
    "counts_by_source",
    """SELECT session_id, snap_no, regexp_extract(location, 'AddOns/([^/]+)/', 1) AS source, count(*) AS objects
    FROM object_snapshots GROUP BY ALL""",
    ("object_snapshots",),
)
def counts_by_source(spark, d):
    return L.counts_by_source(V.object_snapshots(spark, d))


@query(
    "report_topk",
    f"""WITH {CHURN}, {HOT_FUNCTIONS}, {HOT_OBJECTS}, pools AS (SELECT DISTINCT session_id, path FROM pool_snapshots)
    SELECT 'function' AS section, session_id, path AS item, rank FROM hot_functions WHERE rank <= 30
    UNION ALL SELECT 'frame', session_id, path, rank FROM hot_objects WHERE rank <= 30
    UNION ALL SELECT 'churn', session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY replacements DESC, path) AS rank
      FROM churn QUALIFY rank <= 20
    UNION ALL SELECT 'pool', session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY path) AS rank
      FROM pools QUALIFY rank <= 12""",
    ("function_snapshots", "object_snapshots", "pool_snapshots"),
)
def report_topk(spark, d):
    fns = V.function_snapshots(spark, d)
    return report_heads(
        L.hot_functions(fns), L.hot_objects(V.object_snapshots(spark, d)), L.function_churn(fns), L.pool_activity(V.pool_snapshots(spark, d))
    )


STORAGE = """
storage AS (
  WITH f AS (SELECT * FROM storage_roots WHERE phase = 'final'), i AS (SELECT * FROM storage_roots WHERE phase = 'initial'),
  t AS (SELECT session_id, coalesce(sum(bytes) FILTER (phase = 'initial'), 0)::BIGINT AS initial_total,
          coalesce(sum(bytes) FILTER (phase = 'final'), 0)::BIGINT AS final_total FROM storage_roots GROUP BY session_id)
  SELECT f.session_id, f.name, f.bytes, f.bytes - coalesce(i.bytes, 0) AS bytes_delta,
    f.tables - coalesce(i.tables, 0) AS tables_delta, f.entries - coalesce(i.entries, 0) AS entries_delta,
    initial_total, final_total, final_total - initial_total AS total_delta
  FROM f LEFT JOIN i USING (session_id, name) JOIN t USING (session_id))"""


@query("storage_delta", f"WITH {STORAGE} SELECT * FROM storage", ("storage_roots",))
def storage_delta(spark, d):
    return L.storage_delta(V.storage_roots(spark, d))


@query(
    "storage_rank",
    """SELECT session_id, phase, name, bytes, row_number() OVER (PARTITION BY session_id, phase ORDER BY bytes DESC, name) AS rank
    FROM storage_roots""",
    ("storage_roots",),
)
def storage_rank(spark, d):
    return L.storage_rank(V.storage_roots(spark, d)).select("session_id", "phase", "name", "bytes", "rank")


@query(
    "storage_status",
    """SELECT n_name AS addon, CASE WHEN declared = 0 THEN 'not_declared' WHEN loaded = 0 THEN 'not_created' ELSE 'delta' END AS status
    FROM (SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000) AS declared,
            (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9950) AS loaded FROM nation)""",
)
def storage_status(spark, d):
    """A nation stands for an addon, its rich suppliers for declared roots, its richest customers for loaded ones."""
    count = lambda table, key, condition, name: V.table(spark, d, table).filter(condition).groupBy(F.col(key).alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias(name)
    )
    counted = (
        V.table(spark, d, "nation")
        .join(count("supplier", "s_nationkey", "s_acctbal > 7000", "declared"), "n_nationkey", "left")
        .join(count("customer", "c_nationkey", "c_acctbal > 9950", "loaded"), "n_nationkey", "left")
        .na.fill(0, ["declared", "loaded"])
    )
    return counted.select(F.col("n_name").alias("addon"), L.storage_status(F.col("declared"), F.col("loaded")).alias("status"))


def correlated(spark, d):
    """Every layer of a session; sessions are numbered alike in all views."""
    storage = (
        L.storage_delta(V.storage_roots(spark, d)).groupBy("session_id").agg(F.max("total_delta").alias("storage_delta"))
    )
    counters = V.metric_counters(spark, d)
    return C.capture_correlate(
        C.capture_summary(V.samples(spark, d)),
        L.object_lifecycle(V.object_snapshots(spark, d)),
        storage,
        C.memory_delta(counters),
        C.metric_delta(counters),
    )


@query(
    "capture_correlate",
    f"""WITH {LIFECYCLE}, {STORAGE},
    cpu AS (SELECT session_id, count(*) AS sample_count, quantile_disc(last_time, 0.95) AS p95 FROM samples GROUP BY 1),
    st AS (SELECT session_id, max(total_delta) AS storage_delta FROM storage GROUP BY 1),
    m AS (SELECT f.session_id, f.memory - i.memory AS memory_delta, f.over10 - i.over10 AS over10_delta
          FROM metric_counters f JOIN metric_counters i USING (session_id) WHERE f.phase = 'final' AND i.phase = 'initial')
    SELECT cpu.session_id, sample_count, p95, newly_observed, activations, storage_delta, memory_delta, over10_delta
    FROM cpu LEFT JOIN lifecycle USING (session_id) LEFT JOIN st USING (session_id) LEFT JOIN m USING (session_id)""",
    ("samples", "object_snapshots", "storage_roots", "metric_counters"),
)
def capture_correlate(spark, d):
    return correlated(spark, d).select(
        "session_id", "sample_count", "p95", "newly_observed", "activations", "storage_delta", "memory_delta", "over10_delta"
    )


@query(
    "capture_actions",
    f"""WITH {CHURN}, {HOT_FUNCTIONS}, {HOT_OBJECTS}, {STORAGE},
    cpu AS (SELECT session_id, count(*) FILTER (last_time >= 10) AS over10, count(*) FILTER (last_time >= 50) AS over50,
        count(*) FILTER (last_time >= 100) AS over100,
        coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0) AS o, coalesce(sum(last_time::DECIMAL(28,6))::DOUBLE, 0) AS t
      FROM samples GROUP BY 1),
    f AS (SELECT session_id, path FROM hot_functions WHERE rank = 1),
    ob AS (SELECT session_id, path FROM hot_objects WHERE rank = 1),
    c AS (SELECT session_id, sum(replacements)::BIGINT AS n FROM churn GROUP BY 1),
    st AS (SELECT session_id, max(total_delta) AS n FROM storage GROUP BY 1)
    SELECT cpu.session_id,
      CASE WHEN over100 > 0 THEN 'spike_100:' || over100 WHEN over50 > 0 THEN 'spike_50:' || over50 WHEN over10 = 0 THEN 'no_spike' END AS headline,
      coalesce(o / nullif(o + t, 0) * 100 >= 10, false) AS overhead_warning,
      coalesce(nullif(concat_ws(' ', 'hot_function:' || f.path, 'hot_object:' || ob.path,
        CASE WHEN c.n > 0 THEN 'replacements:' || c.n END, CASE WHEN st.n > 0 THEN 'storage_growth:' || st.n END), ''), 'none') AS actions
    FROM cpu LEFT JOIN f USING (session_id) LEFT JOIN ob USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN st USING (session_id)""",
    ("samples", "object_snapshots", "function_snapshots", "storage_roots"),
)
def capture_actions(spark, d):
    fns = V.function_snapshots(spark, d)
    top = lambda df, name: df.filter("rank = 1").select("session_id", F.col("path").alias(name))
    churn = L.function_churn(fns).groupBy("session_id").agg(F.sum("replacements").alias("replacements"))
    storage = L.storage_delta(V.storage_roots(spark, d)).groupBy("session_id").agg(F.max("total_delta").alias("storage_delta"))
    summary = (
        C.capture_summary(V.samples(spark, d))
        .join(top(L.hot_functions(fns, 1), "hot_function"), "session_id", "left")
        .join(top(L.hot_objects(V.object_snapshots(spark, d), 1), "hot_object"), "session_id", "left")
        .join(churn, "session_id", "left")
        .join(storage, "session_id", "left")
    )
    return C.capture_actions(summary).select(
        "session_id", "headline", "overhead_warning", F.array_join("actions", " ").alias("actions")
    )
