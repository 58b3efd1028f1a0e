"""Evidence store, run history, labels and text bounds."""

from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.operators import evidence as S
from fieldscope.operators import history as H
from fieldscope.operators import labels as Lb
from workloads import views as V
from workloads.registry import query

TICKET = """'FSCOPE-' || strftime(make_timestamp(created_at * 1000000), '%Y%m%d-%H%M%S') || '-' || printf('%04d', {n})"""
BY_ID = TICKET.format(n="id // 20")  # accounts share seconds and numbers, so the same ticket occurs in several


def ticketed(spark, d):
    return V.exports(spark, d).withColumn("ticket", S.ticket(F.col("created_at"), F.expr("id div 20")))


@query(
    "evidence_envelope",
    f"""SELECT account, {BY_ID} AS ticket, created_at, kind, title, path, 'text/plain' AS media_type, strlen(content) AS byte_count,
      content, locale, 'fieldscope' AS addon_name, 'fieldscope.evidence.v1' AS schema FROM exports""",
    ("exports",),
)
def evidence_envelope(spark, d):
    return S.evidence_envelope(ticketed(spark, d)).select(
        "account", "ticket", "created_at", "source.kind", "source.title", "source.path", "payload.media_type",
        "payload.byte_count", "payload.content", "environment.locale", "environment.addon_name", "schema",
    )


def stored(spark, d):
    """A store with records of both versions, some broken, some with unknown fields."""
    flat = ticketed(spark, d)
    v1 = S.evidence_envelope(flat.filter("id % 2 = 0"))
    none = lambda kind: F.lit(None).cast(kind)
    client = "struct<client_id:string,version:string,build:string,build_date:string,interface:string,locale:string>"
    new = v1.select(
        "account", "ticket", "schema", F.col("created_at").cast("string").alias("created_at"), "source",
        F.col("payload").withField("byte_count", F.lit(0).cast("bigint")).alias("payload"), "environment", "metadata",
        none("string").alias("kind"), none("string").alias("title"), none("string").alias("content"),
        none("bigint").alias("byte_count"), none(client).alias("client"), none("map<string,string>").alias("extra"),
    )
    source = "struct<kind:string,title:string,path:string>"
    payload = "struct<media_type:string,encoding:string,content:string,byte_count:bigint>"
    env = "struct<addon_name:string,client_id:string,version:string,build:string,build_date:string,interface:string,locale:string>"
    old = flat.filter("id % 2 = 1").select(
        "account", "ticket", none("string").alias("schema"),
        F.when(F.col("id") % 9 == 0, "soon").otherwise(F.col("created_at").cast("string")).alias("created_at"),
        none(source).alias("source"), none(payload).alias("payload"), none(env).alias("environment"),
        F.when(F.col("path").isNotNull(), F.create_map(F.lit("path"), F.col("path"))).alias("metadata"),
        F.when(F.col("id") % 5 != 0, F.col("kind")).alias("kind"), "title",
        F.when(F.col("id") % 15 != 0, F.col("content")).alias("content"), F.lit(1).cast("bigint").alias("byte_count"),
        F.struct(none("string").alias("client_id"), F.lit("0.6").alias("version"), none("string").alias("build"),
                 none("string").alias("build_date"), none("string").alias("interface"), F.col("locale").alias("locale")).alias("client"),
        F.create_map(F.lit("preserved"), F.col("id").cast("string")).alias("extra"),
    )
    return new.unionByName(old)


@query(
    "evidence_migrate",
    f"""SELECT account, {BY_ID} AS ticket, 'fieldscope.evidence.v1' AS schema,
      CASE WHEN id % 2 = 1 AND id % 9 = 0 THEN '0' ELSE created_at::VARCHAR END AS created_at,
      CASE WHEN id % 2 = 1 AND id % 5 = 0 THEN 'unknown' ELSE kind END AS kind, title, path,
      strlen(content) AS byte_count, content, locale, CASE WHEN id % 2 = 1 THEN '0.6' END AS version,
      CASE WHEN id % 2 = 1 THEN id::VARCHAR END AS preserved
    FROM exports WHERE NOT (id % 2 = 1 AND id % 15 = 0)""",
    ("exports",),
)
def evidence_migrate(spark, d):
    return S.evidence_migrate(stored(spark, d)).select(
        "account", "ticket", "schema", "created_at", "source.kind", "source.title", "source.path", "payload.byte_count",
        "payload.content", "environment.locale", "environment.version", F.col("extra")["preserved"].alias("preserved"),
    )


@query(
    "evidence_number",
    f"""WITH l AS (SELECT n_name AS account, n_nationkey * 10 AS last_id FROM nation
        UNION ALL SELECT DISTINCT source, 7 FROM documents WHERE source LIKE '%1'),
      n AS (SELECT account, id, created_at, coalesce(last_id, 0) + row_number() OVER (PARTITION BY account ORDER BY created_at, id) AS number
        FROM exports LEFT JOIN l USING (account))
    SELECT account, id, number, {TICKET.format(n='number')} AS ticket FROM n""",
    ("exports",),
)
def evidence_number(spark, d):
    handed_out = (
        V.table(spark, d, "documents").filter("source LIKE '%1'").select(F.col("source").alias("account")).distinct()
        .withColumn("last_id", F.lit(7))
    )
    return S.evidence_number(V.exports(spark, d), handed_out).select("account", "id", "number", "ticket")


@query(
    "evidence_prune",
    """SELECT account, id, position, running_bytes FROM (
      SELECT account, id, row_number() OVER w AS position, (sum(strlen(content)) OVER w)::BIGINT AS running_bytes
      FROM exports WINDOW w AS (PARTITION BY account ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING))
    WHERE position <= 30 AND running_bytes <= 60000""",
    ("exports",),
)
def evidence_prune(spark, d):
    return S.evidence_prune(V.exports(spark, d), 60000, 30).select("account", "id", "position", "running_bytes")


@query(
    "evidence_stats",
    "SELECT account, count(*) AS records, sum(strlen(content))::BIGINT AS bytes, 16777216::BIGINT AS budget FROM exports GROUP BY account",
    ("exports",),
)
def evidence_stats(spark, d):
    return S.evidence_stats(V.exports(spark, d))


@query("evidence_recent", f"SELECT {BY_ID} AS ticket, created_at FROM exports", ("exports",))
def evidence_recent(spark, d):
    return S.evidence_recent(ticketed(spark, d).select("ticket", "created_at"))


@query("evidence_get", f"SELECT id, account, title FROM exports WHERE {BY_ID} = 'FSCOPE-20231114-221520-0002' AND account = 'src3'", ("exports",))
def evidence_get(spark, d):
    store = ticketed(spark, d).withColumn("created_date", F.date_from_unix_date(F.floor(F.col("created_at") / 86400).cast("int")))
    return S.evidence_get(store, "src3", "FSCOPE-20231114-221520-0002").select("id", "account", "title")


@query(
    "evidence_delete",
    f"SELECT id, account, {BY_ID} AS ticket FROM exports WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)",
    ("exports",),
)
def evidence_delete(spark, d):
    records = ticketed(spark, d).select("id", "account", "ticket", "created_at")
    marked = V.table(spark, d, "labels").filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("id"))
    tombstones = records.join(marked, "id").select("account", "ticket")
    return S.evidence_delete(records, tombstones).select("id", "account", "ticket")


@query(
    "evidence_pending",
    f"""SELECT account, id, {BY_ID} AS ticket, count(*) OVER (PARTITION BY account) AS pending
    FROM exports WHERE id NOT IN (SELECT doc_id FROM labels)""",
    ("exports",),
)
def evidence_pending(spark, d):
    created = ticketed(spark, d).select("account", "id", "ticket")
    persisted = created.join(V.table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")
    pending = S.evidence_pending(created, persisted)
    return pending.join(S.pending_counts(pending), "account")


@query(
    "order_reconcile",
    f"""SELECT account, {BY_ID} AS ticket, id IN (SELECT doc_id FROM labels) AS was_listed,
      row_number() OVER (PARTITION BY account ORDER BY created_at DESC, {BY_ID}) AS position FROM exports""",
    ("exports",),
)
def order_reconcile(spark, d):
    records = ticketed(spark, d).select("account", "ticket", "created_at", "id")
    known = records.join(V.table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id").select("account", "ticket", F.col("id").alias("position"))
    again = known.withColumn("position", F.col("position") + 1000000)
    gone = known.withColumn("ticket", F.concat("ticket", F.lit("-gone")))
    order = known.unionByName(again).unionByName(gone)
    return S.order_reconcile(order, records).select("account", "ticket", "was_listed", "position")


@query(
    "export_chunks",
    f"""WITH c AS (SELECT account, {BY_ID} AS ticket, encode(content) AS b, unnest(range(1, CAST(ceil(strlen(content) / 1500.0) AS BIGINT) + 1)) AS chunk_no
      FROM exports WHERE content <> '')
    SELECT account, ticket, chunk_no::INTEGER AS chunk_no, octet_length(b[(chunk_no - 1) * 1500 + 1 : chunk_no * 1500]) AS bytes,
      sha256(b[(chunk_no - 1) * 1500 + 1 : chunk_no * 1500]) AS digest FROM c""",
    ("exports",),
)
def export_chunks(spark, d):
    return S.export_chunks(ticketed(spark, d), 1500).select(
        "account", "ticket", "chunk_no", F.octet_length("chunk").cast("bigint").alias("bytes"), F.sha2("chunk", 256).alias("digest")
    )


@query(
    "kind_label",
    """SELECT id, kind, CASE kind WHEN 'run_result' THEN 'Run Result' WHEN 'error_log' THEN 'Error Report'
      WHEN 'performance_capture' THEN 'Performance Snapshot' WHEN 'event_log' THEN 'Event Log' ELSE 'Other Data' END AS label FROM exports""",
    ("exports",),
)
def kind_label(spark, d):
    return V.exports(spark, d).select("id", "kind", S.kind_label(F.col("kind")).alias("label"))


@query(
    "format_time",
    """SELECT id, CASE WHEN t > 0 THEN strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS text
    FROM (SELECT id, CASE WHEN id % 10 <> 0 THEN created_at * (1 - 2 * (id % 11 // 10)) END AS t FROM exports)""",
    ("exports",),
)
def format_time(spark, d):
    t = F.when(F.col("id") % 10 != 0, F.col("created_at") * (1 - 2 * F.expr("id % 11 div 10")))
    return V.exports(spark, d).select("id", T.format_time(t).alias("text"))


@query(
    "byte_truncate",
    """WITH b AS (SELECT id, content, encode(content) AS b FROM exports),
    k AS (SELECT *, CASE WHEN strlen(content) <= 181 THEN NULL
        WHEN NOT hex(b[182:182]) BETWEEN '80' AND 'BF' THEN 181
        WHEN NOT hex(b[181:181]) BETWEEN '80' AND 'BF' THEN 180
        WHEN NOT hex(b[180:180]) BETWEEN '80' AND 'BF' THEN 179 ELSE 178 END AS keep FROM b)
    SELECT id, CASE WHEN keep IS NULL THEN content ELSE decode(b[1:keep]) || '...' END AS text FROM k""",
    ("exports",),
)
def byte_truncate(spark, d):
    return V.exports(spark, d).select("id", T.byte_truncate(F.col("content"), 181, "...").alias("text"))


@query(
    "history_normalize",
    """SELECT account, seq, code, result, coalesce(TRY_CAST(succeeded AS BOOLEAN), false) AS succeeded,
      TRY_CAST(timestamp AS BIGINT) AS timestamp FROM history""",
    ("history",),
)
def history_normalize(spark, d):
    return H.history_normalize(V.history(spark, d))


@query(
    "history_append",
    """SELECT account, seq, code, result, coalesce(TRY_CAST(succeeded AS BOOLEAN), false) AS succeeded,
      TRY_CAST(timestamp AS BIGINT) AS timestamp FROM history""",
    ("history",),
)
def history_append(spark, d):
    from fieldscope.session import fresh_dir
    from fieldscope.sources.store import append_history

    path = append_history(V.history(spark, d), fresh_dir(spark, "history"))
    return spark.read.parquet(path).select("account", "seq", "code", "result", "succeeded", "timestamp")


HISTORY_SIZES = """tree AS (SELECT id % 200 AS conv, sum(CASE kind WHEN 'table' THEN 48 WHEN 'string' THEN strlen(value) ELSE 8 END + strlen(key))::BIGINT AS tb
      FROM nodes GROUP BY 1),
    sizes AS (SELECT account, seq, greatest({floor}, strlen(code) + strlen(result) + coalesce(tb, 0) + 128)::BIGINT AS bytes
      FROM history LEFT JOIN tree ON conv = seq // 1000)"""


def sized_history(spark, d):
    trees = H.stored_tree_bytes(V.nodes(spark, d).withColumn("conv", F.col("id") % 200), "conv")
    entries = V.history(spark, d).withColumn("conv", F.expr("seq div 1000"))
    return entries.join(trees, "conv", "left").withColumn("bytes", H.entry_bytes(F.col("tree_bytes")))


@query(
    "history_bytes",
    f"WITH {HISTORY_SIZES.format(floor=16384)} SELECT * FROM sizes",
    ("history", "nodes"),
)
def history_bytes(spark, d):
    return sized_history(spark, d).select("account", "seq", "bytes")


@query(
    "history_prune",
    f"""WITH {HISTORY_SIZES.format(floor=16384)} SELECT account, seq, position, running_bytes FROM (
      SELECT account, seq, row_number() OVER w AS position, (sum(bytes) OVER w)::BIGINT AS running_bytes FROM sizes
      WINDOW w AS (PARTITION BY account ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)) WHERE running_bytes <= 1000000""",
    ("history", "nodes"),
)
def history_prune(spark, d):
    return H.history_prune(sized_history(spark, d), 1000000).select("account", "seq", "position", "running_bytes")


@query(
    "first_line_preview",
    """SELECT account, seq, CASE WHEN strlen(l) <= 22 THEN l WHEN NOT hex(encode(l)[23:23]) BETWEEN '80' AND 'BF' THEN decode(encode(l)[1:22]) || '...'
      WHEN NOT hex(encode(l)[22:22]) BETWEEN '80' AND 'BF' THEN decode(encode(l)[1:21]) || '...' ELSE decode(encode(l)[1:20]) || '...' END AS preview
    FROM (SELECT account, seq, coalesce(nullif(regexp_extract(result, '([^\\r\\n]+)', 1), ''), '(empty)') AS l FROM history)""",
    ("history",),
)
def first_line_preview(spark, d):
    return V.history(spark, d).select("account", "seq", T.first_line_preview(F.col("result")).alias("preview"))


@query(
    "code_normalize",
    """SELECT account, seq, regexp_replace(regexp_replace(code, '^\\s+|\\s+$', '', 'g'), '^/(run|script)\\s+', '', 'i') AS code FROM history""",
    ("history",),
)
def code_normalize(spark, d):
    return V.history(spark, d).select("account", "seq", T.code_normalize(F.col("code")).alias("code"))


@query(
    "label_overlay",
    """SELECT coalesce(b.key, o.key) AS key, coalesce(o.value, b.value) AS value
    FROM (SELECT * FROM labels_ WHERE locale = 'base') b FULL JOIN (SELECT * FROM labels_ WHERE locale = 'enUS') o ON b.key = o.key""",
    ("labels",),
)
def label_overlay(spark, d):
    labels = V.labels(spark, d)
    return Lb.label_overlay(labels.filter("locale = 'base'"), labels.filter("locale = 'enUS'"))


@query(
    "label_parity",
    """SELECT * FROM (SELECT coalesce(b.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'missing_enUS' WHEN b.key IS NULL THEN 'missing_base'
        WHEN o.value = '' THEN 'empty' WHEN strlen(o.value) <> length(o.value) THEN 'not_ascii'
        WHEN regexp_extract_all(b.value, '%[0-9$+\\-.# ]*[cdeEfgGiouXxqs]') <> regexp_extract_all(o.value, '%[0-9$+\\-.# ]*[cdeEfgGiouXxqs]') THEN 'placeholders' END AS problem
      FROM (SELECT * FROM labels_ WHERE locale = 'base') b FULL JOIN (SELECT * FROM labels_ WHERE locale = 'enUS') o ON b.key = o.key)
    WHERE problem IS NOT NULL""",
    ("labels",),
)
def label_parity(spark, d):
    return Lb.label_parity(V.labels(spark, d))
