"""Event and call records, catalog."""

from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.functions.numbers import fixed
from fieldscope.operators import events as E
from fieldscope.operators.names import name_match_roots as match_roots
from workloads import views as V
from workloads.registry import query

ARGUMENTS = """CASE WHEN len(shown) > 16 THEN shown[1:16] || ['<' || (len(shown) - 16) || ' more arguments>'] ELSE shown END"""


@query(
    "event_name_valid",
    "SELECT seq, event, regexp_matches(event, '^[A-Z][A-Z0-9_]*$') AS valid FROM event_records",
    ("event_records",),
)
def event_name_valid(spark, d):
    good, bad = E.split_event_names(V.event_records(spark, d).select("seq", "event"))
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(
    "event_select",
    "SELECT session_id, seq, event FROM event_records WHERE event IN ('CLICK', 'PURCHASE')",
    ("event_records",),
)
def event_select(spark, d):
    records = V.event_records(spark, d).select("session_id", "seq", "event")
    return E.event_select(records, ["CLICK", "PURCHASE", "CLICK"], records)


@query(
    "event_name_normalize",
    """SELECT build, event_name, CASE WHEN length(event_name) % 5 = 0 THEN 'ALL' ELSE event_name END AS normalized FROM catalog""",
    ("catalog",),
)
def event_name_normalize(spark, d):
    typed = F.when(F.length("event_name") % 5 == 0, " 全部事件\n").otherwise(
        F.concat(F.lit("\t "), F.lower("event_name"), F.lit("  \n"))
    )
    return V.catalog(spark, d).select("build", "event_name", T.event_name(typed).alias("normalized"))


def calls(spark, d):
    return V.event_records(spark, d).withColumn("path", F.concat(F.lit("Mod."), F.lower("event"))).drop("event")


@query("trace_filter", "SELECT session_id, seq FROM event_records WHERE lower(event) = 'signup'", ("event_records",))
def trace_filter(spark, d):
    return E.trace_filter(calls(spark, d), " Mod.signup").select("session_id", "seq")


@query(
    "latest_events",
    """SELECT session_id, seq, event, row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, seq DESC) AS rank
    FROM event_records QUALIFY rank <= 500""",
    ("event_records",),
)
def latest_events(spark, d):
    return E.latest_events(V.event_records(spark, d).select("session_id", "seq", "ts_us", "event")).drop("ts_us")


@query(
    "latest_calls",
    """SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, seq DESC) AS rank
    FROM event_records WHERE lower(event) = 'view' QUALIFY rank <= 5""",
    ("event_records",),
)
def latest_calls(spark, d):
    traced = E.trace_filter(calls(spark, d), "Mod.view").select("session_id", "seq", "ts_us")
    return E.latest_calls(traced, 5).drop("ts_us")


@query(
    "elapsed_since_start",
    """SELECT session_id, seq, greatest(0, (ts_us - min(ts_us) OVER (PARTITION BY session_id)) / 1e6::DOUBLE) AS elapsed
    FROM event_records""",
    ("event_records",),
)
def elapsed_since_start(spark, d):
    return E.elapsed_since_start(V.event_records(spark, d).select("session_id", "seq", "ts_us")).drop("ts_us")


@query(
    "format_argument",
    "SELECT seq, i::INTEGER AS position, shown[i] AS text FROM (SELECT seq, shown, unnest(range(1, len(shown) + 1)) AS i FROM event_records)",
    ("event_records",),
)
def format_argument(spark, d):
    one = V.event_records(spark, d).select("seq", F.posexplode("args").alias("p", "a"))
    return one.select("seq", (F.col("p") + 1).alias("position"), T.format_argument(F.col("a.type"), F.col("a.text")).alias("text"))


@query(
    "format_arguments",
    f"SELECT seq, array_to_string({ARGUMENTS}, ', ') AS summary, len({ARGUMENTS})::INTEGER AS n FROM event_records",
    ("event_records",),
)
def format_arguments(spark, d):
    return E.formatted(V.event_records(spark, d)).select("seq", "summary", F.size("arguments").alias("n"))


@query(
    "event_detail",
    f"""WITH t AS (SELECT seq, event, {ARGUMENTS} AS a,
        greatest(0, (ts_us - min(ts_us) OVER (PARTITION BY session_id)) / 1e6::DOUBLE) AS elapsed FROM event_records)
    SELECT seq, concat_ws(chr(10), 'Event: ' || event, 'Elapsed: +' || printf('%.3f', elapsed) || ' seconds', '',
      array_to_string(list_transform(range(1, len(a) + 1), lambda i: '[' || i || '] = ' || a[i]), chr(10))) AS detail FROM t""",
    ("event_records",),
)
def event_detail(spark, d):
    records = E.formatted(E.elapsed_since_start(V.event_records(spark, d)))
    return records.select("seq", E.event_detail(F.col("event"), F.col("elapsed"), F.col("arguments")).alias("detail"))


@query(
    "event_signature",
    """WITH names AS (SELECT p_size % 3 AS build, CASE WHEN p_partkey % 50 = 0 THEN 'ALL' ELSE
        upper(replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '')) || CASE WHEN p_partkey % 7 = 0 THEN '_X' ELSE '' END END AS event_name,
        p_partkey AS id FROM part)
    SELECT id, build, event_name, CASE WHEN event_name = 'ALL' THEN '*' ELSE signature END AS signature
    FROM names LEFT JOIN catalog USING (build, event_name)""",
    ("catalog",),
)
def event_signature(spark, d):
    k = F.col("p_partkey")
    name = F.upper(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.regexp_replace("p_brand", "#", "")))
    asked = V.table(spark, d, "part").select(
        k.alias("id"),
        (F.col("p_size") % 3).cast("bigint").alias("build"),
        F.when(k % 50 == 0, "ALL").when(k % 7 == 0, F.concat(name, F.lit("_X"))).otherwise(name).alias("event_name"),
    )
    return E.event_signature(asked, V.catalog(spark, d)).select("id", "build", "event_name", "signature")


@query(
    "catalog_search",
    """SELECT event_name, signature, match FROM (
      SELECT event_name, signature, CASE WHEN event_name = 'WIDGET' THEN 1 WHEN strpos(event_name, 'WIDGET') = 1 THEN 2
        WHEN strpos(event_name, 'WIDGET') > 1 THEN 3 END AS match FROM catalog WHERE build = 0)
    WHERE match IS NOT NULL ORDER BY match, event_name LIMIT 8""",
    ("catalog",),
)
def catalog_search(spark, d):
    return E.catalog_search(V.catalog(spark, d).filter("build = 0"), " widget")


@query("catalog_counts", "SELECT build, count(*) AS events FROM catalog GROUP BY build", ("catalog",))
def catalog_counts(spark, d):
    return E.catalog_counts(V.catalog(spark, d))


@query(
    "catalog_compare",
    """SELECT coalesce(l.event_name, r.event_name) AS event_name,
      CASE WHEN r.event_name IS NULL THEN 'only_left' WHEN l.event_name IS NULL THEN 'only_right' ELSE 'common' END AS presence,
      coalesce(l.signature <> r.signature, false) AS signature_differs
    FROM (SELECT * FROM catalog WHERE build = 0) l FULL JOIN (SELECT * FROM catalog WHERE build = 1) r ON l.event_name = r.event_name""",
    ("catalog",),
)
def catalog_compare(spark, d):
    return E.catalog_compare(V.catalog(spark, d), 0, 1)


@query(
    "distinct_first",
    "SELECT session_id, event, min(seq) AS first_position FROM event_records GROUP BY session_id, event",
    ("event_records",),
)
def distinct_first(spark, d):
    return E.distinct_first(V.event_records(spark, d), ["session_id", "event"], "seq")


@query(
    "normalize_name",
    """SELECT build, event_name, regexp_replace(lower(event_name), '[^a-z0-9]', '', 'g') || 'fin' AS normalized FROM catalog""",
    ("catalog",),
)
def normalize_name(spark, d):
    painted = F.concat(F.lit("|cFF00aa11"), F.col("event_name"), F.lit("|r Fin"))
    return V.catalog(spark, d).select("build", "event_name", T.normalize_name(painted).alias("normalized"))


@query(
    "name_match_roots",
    """WITH k AS (SELECT DISTINCT event_name AS key, regexp_replace(lower(event_name), '[^a-z0-9]', '', 'g') AS kn FROM catalog),
    a AS (SELECT addon, regexp_replace(lower(addon), '[^a-z0-9]', '', 'g') AS an
      FROM (SELECT DISTINCT p_name AS addon FROM part UNION SELECT DISTINCT p_name || ' ' || p_brand || ' extra' FROM part))
    SELECT addon, key, row_number() OVER (PARTITION BY addon ORDER BY key) AS rank, count(*) OVER (PARTITION BY addon) AS matches
    FROM k JOIN a ON length(kn) >= 4 AND length(an) >= 4 AND (contains(kn, an) OR contains(an, kn))""",
    ("catalog",),
)
def name_match_roots(spark, d):
    part = V.table(spark, d, "part")
    addons = part.select(F.col("p_name").alias("addon")).unionByName(
        part.select(F.concat_ws(" ", "p_name", "p_brand", F.lit("extra")).alias("addon"))
    )
    return match_roots(V.catalog(spark, d).select(F.col("event_name").alias("key")), addons)
