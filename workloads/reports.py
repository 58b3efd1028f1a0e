"""Text reports, thinning, masking, and the store as a table on disk."""

from functools import cached_property

from pyspark.sql import functions as F

from fieldscope.functions import report_wording as W
from fieldscope.operators import capture as C
from fieldscope.operators import evidence as S
from fieldscope.operators import lifecycle as L
from fieldscope.operators import reports as R
from fieldscope.operators import secrets as X
from fieldscope.operators.thinning import downsample_gap as thin
from fieldscope.session import fresh_dir, pin
from fieldscope.sources.store import EvidenceStore
from workloads import views as V
from workloads.evidence import TICKET
from workloads.health import ADDONS, CODES, SEVERITY, TOTALS, _bytes, _ms, snapshot
from workloads.lifecycle import CHURN, HOT_FUNCTIONS, HOT_OBJECTS, LIFECYCLE, NEW_FUNCTIONS, POOLS, STORAGE
from workloads.registry import query


def lines_sql(source: str, key: str, section: int, *lines: str) -> str:
    """SQL for one section of consecutive lines; null lines do not count."""
    listed = ", ".join(lines)
    return f"""SELECT {key}, {section} AS section, unnest(range(0, len(t))) AS item, unnest(t) AS line
      FROM (SELECT {key}, list_filter([{listed}], lambda x: x IS NOT NULL) AS t FROM {source})"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pct(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN '--' WHEN {x} > 0 AND {x} < 0.01 THEN '<0.01%'
      WHEN {x} < 0.1 THEN printf('%.2f%%', {x}) WHEN {x} < 10 THEN printf('%.1f%%', {x}) ELSE printf('%.0f%%', {x}) END"""


def memory(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '--' WHEN {x} >= 1024 THEN printf('%.1f MB', {x} / 1024) ELSE printf('%.0f KB', {x}) END"


def signed(x: str, text: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '--' ELSE CASE WHEN {x} > 0 THEN '+' WHEN {x} < 0 THEN '-' ELSE '' END || ({text}) END"


def signed_memory(x: str) -> str:
    return signed(x, f"CASE WHEN abs({x}) >= 1024 THEN printf('%.1f MB', abs({x}) / 1024) ELSE printf('%.0f KB', abs({x})) END")


def signed_bytes(x: str) -> str:
    return signed(x, _bytes(x))


def fill(pattern: str, *values: str) -> str:
    """A line format as SQL: texts and numbers put in for %s, %d, %02d and %+d."""
    out, rest = [], pattern
    for v in values:
        at = rest.index("%")
        while rest[at : at + 2] == "%%":
            at = rest.index("%", at + 2)
        spec = next(s for s in ("%02d", "%+d", "%s", "%d") if rest[at:].startswith(s))
        out.append(lit(rest[:at].replace("%%", "%")))
        out.append(f"printf('{spec}', ({v})::BIGINT)" if spec in ("%02d", "%+d") else f"({v})")
        rest = rest[at + len(spec) :]
    out.append(lit(rest.replace("%%", "%")))
    return " || ".join(out)


FINDING = "CASE c " + " ".join(
    [f"WHEN '{k}' THEN {fill('- ' + v, f'{col}::BIGINT')}" for (k, v), col in zip(W.COUNT_FINDINGS.items(), ("over1000", "over500", "over100", "over50"))]
    + [
        f"""WHEN '{k}' THEN {fill('- ' + v, f"printf('%.3f', {col})")}"""
        for (k, v), col in zip(W.TIME_FINDINGS.items(), ("recent_average", "recent_average", "encounter_average", "peak_time"))
    ]
) + " END"

RISK = "CASE " + " ".join(f"WHEN severity >= {k} THEN {lit(v)}" for k, v in sorted(W.RISK.items(), reverse=True)) + " END"


@query(
    "health_report",
    f"""WITH {ADDONS}, {TOTALS}, s AS (
      SELECT *, coalesce(title, name) AS shown, {CODES} AS codes, ({SEVERITY}) AS severity,
        CASE WHEN a - o + recent_average > 0 THEN greatest(0, recent_average / (a - o + recent_average) * 100) END AS share,
        CASE WHEN a > 0 THEN greatest(0, o / a * 100) END AS overall
      FROM addons JOIN totals USING (client_id) WHERE loaded),
    f AS (SELECT *, unnest(string_split(codes, ',')) AS c, unnest(range(1, len(string_split(codes, ',')) + 1)) AS i FROM s)
    {lines_sql('s', 'client_id, name', 0, lit(W.BASELINE), "shown || '  (' || name || ')'", lit(W.CONCLUSION))}
    UNION ALL SELECT client_id, name, 1, 0, 'Risk: ' || {RISK} FROM s
    UNION ALL SELECT client_id, name, 1, i, CASE WHEN c = '' THEN {lit(W.NO_FINDINGS)} ELSE {FINDING} END FROM f
    UNION ALL {lines_sql('s', 'client_id, name', 2, lit(W.CURRENT_LOAD), "'Recent: ' || " + _ms('recent_average'), "'Addon Share: ' || " + pct('share'),
      fill(W.ALL_SHARE, pct('overall')), "'Memory: ' || " + memory('memory'))}
    UNION ALL {lines_sql('s', 'client_id, name', 3, lit(W.LONG_TERM), "'Session Average: ' || " + _ms('session_average'), "'Encounter: ' || " + _ms('encounter_average'),
      "'Peak: ' || " + _ms('peak_time'), fill('1/5/10ms: %d / %d / %d', *[f'over{k}::BIGINT' for k in (1, 5, 10)]),
      fill('50/100/500/1000ms: %d / %d / %d / %d', *[f'over{k}::BIGINT' for k in (50, 100, 500, 1000)]))}
    UNION ALL {lines_sql('s', 'client_id, name', 4, lit(W.CAPABILITIES), lit('- ' + W.PROFILER_READY), lit('- ' + W.DEEP_MISSING), lit('- Client Bottleneck: CPU bound'))}
    UNION ALL {lines_sql('s', 'client_id, name', 5, lit(W.NEXT_ACTION), lit(W.START_GUIDE))}""",
    ("metric_counters",),
)
def health_report(spark, d):
    return R.health_report(snapshot(spark, d), cpu_bound=True)


SHARE = """CASE WHEN application_last - overall_last + last_time > 0
  THEN greatest(0, last_time / (application_last - overall_last + last_time) * 100) END"""
SUMMARY = f"""summary AS (
  SELECT *, o / nullif(o + t, 0) * 100 AS ratio FROM (
    SELECT session_id, count(*) AS n, quantile_disc(last_time, 0.5) AS p50, quantile_disc(last_time, 0.95) AS p95, quantile_disc(last_time, 0.99) AS p99,
      coalesce(greatest(0, max(last_time)), 0) AS maximum, quantile_disc(recent_average, 0.95) AS recent_p95,
      quantile_disc(self_overhead, 0.95) AS overhead_p95, coalesce(sum(last_time::DECIMAL(28,6))::DOUBLE, 0) AS t,
      coalesce(sum(self_overhead::DECIMAL(28,6))::DOUBLE, 0) AS o, count(*) FILTER (last_time > 0) AS active,
      quantile_disc({SHARE}, 0.5) AS s50, quantile_disc({SHARE}, 0.95) AS s95,
      {", ".join(f"count(*) FILTER (last_time >= {k}) AS over{k}" for k in (1, 5, 10, 50, 100))}
    FROM samples GROUP BY session_id))"""
DELTA = """delta AS (SELECT f.session_id, """ + ", ".join(
    f"f.over{k} - i.over{k} AS d{k}" for k in (10, 50, 100, 500, 1000)
) + """, f.memory - i.memory AS memory_delta FROM metric_counters f JOIN metric_counters i USING (session_id) WHERE f.phase = 'final' AND i.phase = 'initial')"""


def label(name: str, text: str) -> str:
    return f"{lit(name + ': ')} || {text}"


CPU_SQL = f"""
    {lines_sql('(SELECT * FROM summary LEFT JOIN delta USING (session_id))', 'session_id', 0, lit(W.CPU_TITLE), label('P50', _ms('p50')), label('P95', _ms('p95')),
      label('P99', _ms('p99')), label(W.MAXIMUM, _ms('maximum')), label(W.RECENT_P95, _ms('recent_p95')), label(W.ANALYZER_OVERHEAD, _ms('overhead_p95')),
      fill(W.SAMPLE_ACTIVITY, 'active', 'n', _ms('t')), fill(W.RELATIVE_LOAD, pct('s50'), pct('s95')),
      fill(W.SAMPLE_SPIKES, *[f'over{k}' for k in (1, 5, 10, 50, 100)]), fill(W.COUNTER_SPIKES, *[f'coalesce(d{k}, 0)::BIGINT' for k in (10, 50, 100, 500, 1000)]),
      f"CASE WHEN ratio >= 10 THEN {fill(W.OVERHEAD_WARNING, pct('ratio'))} ELSE {fill(W.OVERHEAD_OK, pct('ratio'))} END")}
    UNION ALL {lines_sql('summary', 'session_id', 1, lit(W.FUNCTION_HOTSPOTS))}
    UNION ALL SELECT session_id, 2, rank, {fill(W.FUNCTION_ROW, 'rank', _ms('elapsed'), _ms('inclusive'), 'path', 'calls', _ms('average'))}
      FROM hot_functions WHERE rank <= 30
    UNION ALL SELECT session_id, 2, 0, {lit(W.NO_HOTSPOT)} FROM summary WHERE session_id NOT IN (SELECT session_id FROM hot_functions)
    UNION ALL {lines_sql('summary', 'session_id', 3, lit(W.FRAME_HOTSPOTS))}
    UNION ALL SELECT session_id, 4, rank, {fill(W.FRAME_ROW, 'rank', _ms('elapsed'), 'path', 'calls', _ms('average'))} FROM hot_objects WHERE rank <= 30
    UNION ALL SELECT session_id, 4, 0, {lit(W.NO_HOTSPOT)} FROM summary WHERE session_id NOT IN (SELECT session_id FROM hot_objects)"""


class Layers:
    """What the reports of all captures are made of; ``keep`` is applied to what several reports share, objects come ``without`` some columns."""

    def __init__(self, spark, d, keep=lambda df, label: df, without=()):
        self.spark, self.d, self.keep, self.without = spark, d, keep, without
        self.samples = V.samples(spark, d)
        self.counters = V.metric_counters(spark, d)
        self.functions = V.function_snapshots(spark, d)

    @cached_property
    def objects(self):
        return self.keep(V.object_snapshots(self.spark, self.d).drop(*self.without), "objects")

    @cached_property
    def summary(self):
        return self.keep(C.capture_summary(self.samples), "summary")

    @cached_property
    def hot_functions(self):
        return self.keep(L.hot_functions(self.functions), "hot-functions")

    @cached_property
    def hot_objects(self):
        return self.keep(L.hot_objects(self.objects), "hot-objects")

    @cached_property
    def churn(self):
        return self.keep(L.function_churn(self.functions), "churn")

    @cached_property
    def lifecycle(self):
        return self.keep(L.object_lifecycle(self.objects), "lifecycle")

    @cached_property
    def totals(self):
        return self.keep(L.object_totals(self.objects), "totals")

    @cached_property
    def pools(self):
        return self.keep(L.pool_activity(V.pool_snapshots(self.spark, self.d)), "pools")

    @cached_property
    def storage(self):
        return self.keep(L.storage_delta(V.storage_roots(self.spark, self.d)), "storage")

    def cpu_report(self):
        summary = self.summary.join(C.metric_delta(self.counters), "session_id", "left")
        return R.cpu_report(summary, self.hot_functions, self.hot_objects)

    def capture_report(self):
        first = lambda df, *cols: df.filter("rank = 1").select("session_id", *cols)
        hot = first(self.hot_functions, F.col("path").alias("hot_function"), F.col("elapsed").alias("hot_function_time"))
        top = first(
            self.hot_objects, F.col("path").alias("hot_object"), F.col("elapsed").alias("hot_object_time"), F.col("calls").alias("hot_object_calls")
        )
        span = self.samples.groupBy("session_id").agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("elapsed"))
        churn = self.churn.groupBy("session_id").agg(F.sum("replacements").alias("replacements"))
        grown = self.storage.groupBy("session_id").agg(F.max("total_delta").alias("storage_delta"))
        joined = self.summary.join(span.withColumn("stop_reason", F.lit("manual")), "session_id")
        for side in (hot, top, churn, grown, C.memory_delta(self.counters)):
            joined = joined.join(side, "session_id", "left")
        return R.capture_report(joined)

    def object_report(self):
        coarse = self.functions.withColumn("snap_no", F.expr("snap_no div 8000"))
        final = self.totals.groupBy("session_id").agg(F.max("snap_no").alias("snap_no"))
        shown = self.objects.join(final, ["session_id", "snap_no"], "left_semi")  # all that the report tells by type and source
        return R.object_report(
            self.lifecycle, self.totals, L.counts_by_type(shown), L.counts_by_source(shown), L.new_functions(coarse), self.churn, self.pools
        )

    def storage_report(self):
        declared = V.storage_roots(self.spark, self.d).groupBy("session_id").agg(
            F.count_distinct("name").alias("declared"), F.count_if(F.col("phase") == "final").alias("loaded")
        )
        return R.storage_report(declared, self.storage)


CPU_VIEWS = ("samples", "metric_counters", "function_snapshots", "object_snapshots")


@query("cpu_report", f"WITH {SUMMARY}, {DELTA}, {HOT_FUNCTIONS}, {HOT_OBJECTS} {CPU_SQL}", CPU_VIEWS)
def cpu_report(spark, d):
    return Layers(spark, d).cpu_report()


STORAGE_TOTALS = "s AS (SELECT session_id, max(initial_total) AS i, max(final_total) AS f, max(total_delta) AS dl FROM storage GROUP BY 1)"
STORAGE_SQL = f"""
    {lines_sql('s', 'session_id', 0, lit(W.STORAGE_TITLE), lit(W.STORAGE_NOTE), fill(W.STORAGE_TOTAL, _bytes('i'), _bytes('f'), signed_bytes('dl')),
      f"CASE WHEN dl = 0 THEN {lit(W.STORAGE_NO_CHANGE)} END")}
    UNION ALL SELECT session_id, 1, -abs(bytes_delta), {fill(W.STORAGE_ROOT, 'name', signed_bytes('bytes_delta'), 'tables_delta', 'entries_delta')} FROM storage"""


@query("storage_report", f"WITH {STORAGE}, {STORAGE_TOTALS} {STORAGE_SQL}", ("storage_roots",))
def storage_report(spark, d):
    return Layers(spark, d).storage_report()


@query(
    "benchmark_report",
    f"""WITH b AS (SELECT run_id, count(*) AS n, sum(e::DECIMAL(28,6))::DOUBLE / count(*) AS mean, quantile_disc(e, 0.5) AS p50,
        quantile_disc(e, 0.95) AS p95, quantile_disc(e, 0.99) AS p99, max(e) AS maximum, sum(allocated)::DOUBLE / count(*) AS a,
        sum(allocated - deallocated)::DOUBLE / count(*) AS net, count(*) * 1000 / nullif(sum(e::DECIMAL(28,6))::DOUBLE, 0) AS cps
      FROM (SELECT *, coalesce(elapsed, 0) AS e FROM benchmark_samples) GROUP BY run_id)
    {lines_sql('b', 'run_id', 0, lit(W.REPORT_TITLE), 'run_id', fill(W.BENCHMARK_META, 'n', lit(W.WITHOUT_ARGUMENTS)), lit(W.EXACT), label(W.MEAN, _ms('mean')),
      label('P50', _ms('p50')), label('P95', _ms('p95')), label('P99', _ms('p99')), label(W.MAXIMUM, _ms('maximum')), label(W.ALLOCATED, signed_bytes('a')),
      label(W.NET_ALLOCATION, signed_bytes('net')), label(W.THROUGHPUT, "coalesce(printf('%.1f', cps), '--')"))}""",
    ("benchmark_samples",),
)
def benchmark_report(spark, d):
    return R.benchmark_report(C.benchmark_summary(V.benchmark_samples(spark, d)))


CAPTURE_VIEWS = ("samples", "metric_counters", "function_snapshots", "object_snapshots", "storage_roots")
CAPTURE_CTE = f"""{SUMMARY}, {DELTA}, {HOT_FUNCTIONS}, {HOT_OBJECTS}, {CHURN}, {STORAGE},
    span AS (SELECT session_id, (max(ts_us) - min(ts_us)) / 1e6::DOUBLE AS seconds FROM samples GROUP BY 1),
    c AS (SELECT * FROM summary JOIN span USING (session_id) LEFT JOIN delta USING (session_id)
      LEFT JOIN (SELECT session_id, path AS hf, elapsed AS hft FROM hot_functions WHERE rank = 1) USING (session_id)
      LEFT JOIN (SELECT session_id, path AS ho, elapsed AS hot, calls AS hoc FROM hot_objects WHERE rank = 1) USING (session_id)
      LEFT JOIN (SELECT session_id, sum(replacements)::BIGINT AS rep FROM churn GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, max(total_delta) AS grown FROM storage GROUP BY 1) USING (session_id))"""
CAPTURE_SQL = f"""
    {lines_sql('c', 'session_id', 0, lit(W.CONCLUSION), fill(W.CAPTURE_META, "printf('%.2f', seconds)", 'n', "'manual'"),
      f"CASE WHEN over100 > 0 THEN {fill('- ' + W.COUNT_FINDINGS['spike_100'], 'over100')} WHEN over50 > 0 THEN {fill('- ' + W.COUNT_FINDINGS['spike_50'], 'over50')} WHEN over10 = 0 THEN {lit('- ' + W.NO_SPIKE)} END",
      label('- P95', _ms('p95')), label('- ' + W.MAXIMUM, _ms('maximum')), label('- ' + W.MEMORY_DELTA, signed_memory('memory_delta')))}
    UNION ALL {lines_sql('c', 'session_id', 1, lit(W.NEXT_ACTION), fill('- ' + W.ACTION_FUNCTION, 'hf', _ms('hft')), f"CASE WHEN ho IS NOT NULL THEN {fill('- ' + W.ACTION_OBJECT, 'ho', _ms('hot'), 'hoc')} END",
      f"CASE WHEN rep > 0 THEN {fill('- ' + W.ACTION_REPLACED, 'rep')} END",
      f"CASE WHEN grown > 0 THEN {fill('- ' + W.ACTION_STORAGE, signed_bytes('grown'))} END",
      f"CASE WHEN hf IS NULL AND ho IS NULL AND coalesce(rep, 0) <= 0 AND coalesce(grown, 0) <= 0 THEN {lit('- ' + W.NO_HOTSPOT)} END")}
    UNION ALL {lines_sql('c', 'session_id', 2, lit(W.RAW_EVIDENCE), label('P50', _ms('p50')), label('P95', _ms('p95')), label('P99', _ms('p99')),
      label(W.MAXIMUM, _ms('maximum')), fill(W.RELATIVE_LOAD, pct('s50'), pct('s95')))}"""


@query("capture_report", f"WITH {CAPTURE_CTE} {CAPTURE_SQL}", CAPTURE_VIEWS)
def capture_report(spark, d):
    return Layers(spark, d).capture_report()


OBJECT_VIEWS = ("object_snapshots", "function_snapshots", "pool_snapshots")
OBJECT_PARTS = f"""{LIFECYCLE}, {NEW_FUNCTIONS}, {POOLS},
    last AS (SELECT * FROM object_snapshots QUALIFY snap_no = max(snap_no) OVER (PARTITION BY session_id)),
    o AS (SELECT *, (SELECT count(*) FROM last l WHERE l.session_id = lifecycle.session_id AND on_update) AS updating,
        (SELECT count(*) FROM last l WHERE l.session_id = lifecycle.session_id AND shown) AS visible
      FROM lifecycle LEFT JOIN new_functions USING (session_id)
      LEFT JOIN (SELECT session_id, sum(replacements)::BIGINT AS replaced FROM churn GROUP BY 1) USING (session_id)),
    kinds AS (SELECT session_id, coalesce(object_type, 'unknown') AS k, count(*) AS n FROM last GROUP BY ALL),
    sources AS (SELECT session_id, regexp_extract(location, 'AddOns/([^/]+)/', 1) AS k, count(*) AS n FROM last GROUP BY ALL),
    paths AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY replacements DESC, path) AS rank FROM churn QUALIFY rank <= 20),
    listed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path, pool_id) AS rank FROM pools QUALIFY rank <= 12)"""
OBJECT_CTE = f"{CHURN}, {OBJECT_PARTS}"
OBJECT_SQL = f"""
    {lines_sql('o', 'session_id', 0, lit(W.OBJECTS_TITLE), fill(W.OBJECT_COUNTS, 'initial_objects', 'final_objects', 'peak_objects', 'newly_observed'),
      fill(W.OBJECT_TRANSITIONS, 'hidden_transitions', 'activations', pct('reuse_rate')), label(W.ON_UPDATE, 'updating'), fill(W.VISIBLE, 'visible'), lit(W.OBJECT_TYPES))}
    UNION ALL SELECT session_id, 1, -n, k || ': ' || n FROM kinds
    UNION ALL {lines_sql('o', 'session_id', 2, lit(W.OBJECT_SOURCES))}
    UNION ALL SELECT session_id, 3, -n, k || ': ' || n FROM sources
    UNION ALL {lines_sql('o', 'session_id', 4, lit(W.CLOSURES),
      fill(W.FUNCTION_COUNTS, 'coalesce(functions_discovered, 0)', 'coalesce(function_references, 0)', 'coalesce(new_function_instances, 0)', 'coalesce(replaced, 0)'))}
    UNION ALL SELECT session_id, 5, rank, {fill(W.CHURN_ROW, 'path', 'replacements')} FROM paths
    UNION ALL SELECT session_id, 5, 0, {lit(W.NO_CHURN)} FROM o WHERE session_id NOT IN (SELECT session_id FROM churn)
    UNION ALL {lines_sql('o', 'session_id', 6, lit(W.POOLS))}
    UNION ALL SELECT session_id, 7, rank, concat_ws(chr(10), path, {fill(W.POOL_ACTIVE, 'initial_active', 'final_active', 'peak_active')},
      {fill(W.POOL_REUSE, 'acquisitions', 'releases', "printf('%.1f', coalesce(reuse_rate, 0))")}) FROM listed
    UNION ALL SELECT session_id, 7, 0, {lit(W.NO_POOLS)} FROM o WHERE session_id NOT IN (SELECT session_id FROM pools)
    UNION ALL {lines_sql('o', 'session_id', 8, lit(W.LIMITS), lit(W.TRANSIENT_LIMIT), lit(W.POOL_HEURISTIC))}"""


@query("object_report", f"WITH {OBJECT_CTE} {OBJECT_SQL}", OBJECT_VIEWS)
def object_report(spark, d):
    return Layers(spark, d, pin, ("path", "self_time", "self_calls")).object_report()


TIMELINE_SQL = f"""
    SELECT session_id, 1, ts_us, {fill(W.RAW_SAMPLE, "printf('%.2f', (ts_us - min(ts_us) OVER (PARTITION BY session_id)) / 1e6::DOUBLE)",
      *[_ms(c) for c in ('last_time', 'recent_average', 'overall_last', 'application_last', 'self_overhead')])} FROM samples"""
PARTS = (CAPTURE_SQL, CPU_SQL, OBJECT_SQL, STORAGE_SQL, TIMELINE_SQL)


@query(
    "full_report",
    f"WITH {CAPTURE_CTE}, {OBJECT_PARTS}, {STORAGE_TOTALS} "
    + " UNION ALL ".join(f"SELECT session_id, {i} AS part, section, item, line FROM ({sql}) t{i}(session_id, section, item, line)" for i, sql in enumerate(PARTS))
    + f" UNION ALL SELECT DISTINCT session_id, 4, 0, 0, {lit(W.TIMELINE)} FROM samples",
    (*CAPTURE_VIEWS, "pool_snapshots"),
)
def full_report(spark, d):
    layers = Layers(spark, d, pin)
    starts = layers.samples.groupBy("session_id").agg(F.min("ts_us").alias("start"))
    raw = layers.samples.join(starts, "session_id").withColumn("elapsed", (F.col("ts_us") - F.col("start")) / 1e6)
    return R.full_report(
        starts.select("session_id"), layers.capture_report(), layers.cpu_report(), layers.object_report(), layers.storage_report(), R.timeline(raw)
    )


@query(
    "downsample_gap",
    """WITH RECURSIVE s AS (SELECT DISTINCT session_id, ts_us FROM samples),
    n AS (SELECT session_id, ts_us, first_value(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us
      RANGE BETWEEN 21600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM s),
    r AS (SELECT session_id, min(ts_us) AS ts_us FROM s GROUP BY 1
      UNION ALL SELECT n.session_id, n.following FROM r JOIN n USING (session_id, ts_us) WHERE n.following IS NOT NULL)
    SELECT r.session_id, r.ts_us, min(sample_id) AS sample_id FROM r JOIN samples USING (session_id, ts_us) GROUP BY ALL""",
    ("samples",),
)
def downsample_gap(spark, d):
    return thin(V.samples(spark, d), gap_us=21_600_000_000, span_us=86_400_000_000)


@query(
    "mask_secrets",
    """SELECT n.id, n.parent_id, n.key, CASE WHEN n.id % 19 = 0 THEN '<secret>' ELSE value END AS value, secret_keys
    FROM nodes n JOIN (SELECT parent_id, count(*) FILTER (id % 17 = 0) AS secret_keys FROM nodes GROUP BY 1) c ON n.parent_id = c.parent_id
    WHERE n.id % 17 <> 0""",
    ("nodes",),
)
def mask_secrets(spark, d):
    entries = V.nodes(spark, d).withColumn("key_secret", F.col("id") % 17 == 0).withColumn("value_secret", F.col("id") % 19 == 0)
    return X.mask_secrets(entries).join(X.secret_key_counts(entries, "parent_id"), "parent_id").select("id", "parent_id", "key", "value", "secret_keys")


def two_appends(spark, d):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    exports = V.exports(spark, d)
    store.append(exports.filter("id % 2 = 0"))
    return store, exports.filter("id % 2 = 1")


NUMBERED = """n AS (SELECT *, CASE WHEN id % 2 = 1 THEN count(*) FILTER (id % 2 = 0) OVER (PARTITION BY account) ELSE 0 END
    + row_number() OVER (PARTITION BY account, id % 2 ORDER BY created_at, id) AS number FROM exports)"""


@query(
    "evidence_append",
    f"WITH {NUMBERED} SELECT account, {TICKET.format(n='number')} AS ticket, strlen(content) AS byte_count FROM n WHERE content <> ''",
    ("exports",),
)
def evidence_append(spark, d):
    store, second = two_appends(spark, d)
    store.append(second)
    return store.records().select("account", "ticket", "payload.byte_count")


@query(
    "table_clear",
    f"""WITH {NUMBERED} SELECT account, {TICKET.format(n='number')} AS ticket,
      (SELECT count(*) FROM exports WHERE id % 2 = 0 AND content <> '') AS removed FROM n WHERE content <> '' AND id % 2 = 1""",
    ("exports",),
)
def table_clear(spark, d):
    store, second = two_appends(spark, d)
    removed = store.clear()
    store.append(second)
    return store.records().select("account", "ticket", F.lit(removed).cast("bigint").alias("removed"))
