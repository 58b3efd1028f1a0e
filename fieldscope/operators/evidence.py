"""Evidence store: envelope, migration, numbering, retention, lookup, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from fieldscope.functions import wording as W
from fieldscope.functions.text import byte_truncate
from fieldscope.plans import chunk_of, running_total, top_per_key

ENVIRONMENT = ("addon_name", "client_id", "version", "build", "build_date", "interface", "locale")


def kind_label(kind: Column) -> Column:
    """Label of a report kind; kinds without one share a fallback."""
    table = F.create_map(*[F.lit(part) for pair in W.KIND_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(W.UNKNOWN_KIND))


def accepted(exports: DataFrame, limit: int = W.STORE_BYTES) -> DataFrame:
    """Exports that can be stored: neither empty nor above the byte limit."""
    return exports.filter((F.octet_length("content") > 0) & (F.octet_length("content") <= limit))


def evidence_number(exports: DataFrame, last_ids: DataFrame | None = None) -> DataFrame:
    """Give every export the next id of its account and its ticket.

    Ids rise with creation; ``last_ids`` (account, last_id) holds what was handed out
    before, also to records that are gone by now. Empty and oversize exports take an id
    too, so ids may have gaps once those are dropped.
    """
    order = [F.col("created_at"), F.col("id")]
    numbered = running_total(exports, ["account"], order, chunk_of(exports, order), F.lit(1), "_n")
    if last_ids is None:
        base = F.lit(0)
    else:
        numbered = numbered.join(last_ids.select("account", "last_id"), "account", "left")
        base = F.coalesce("last_id", F.lit(0))
    result = numbered.withColumn("number", F.col("_n") + base).drop("_n", "last_id")
    return result.withColumn("ticket", ticket(F.col("created_at"), F.col("number")))


def ticket(created_at: Column, number: Column) -> Column:
    """``PREFIX-yyyyMMdd-HHmmss-0001`` in UTC."""
    day = F.date_format(F.date_from_unix_date(F.floor(created_at / 86400).cast("int")), "yyyyMMdd")
    second = F.pmod(created_at, F.lit(86400))
    return F.format_string(
        W.TICKET_PREFIX + "-%s-%02d%02d%02d-%04d",
        day,
        F.floor(second / 3600),
        F.floor(second / 60) % 60,
        second % 60,
        number,
    )


def ticket_number(ticket_text: Column) -> Column:
    """The number at the end of a ticket, null if it has none."""
    return F.nullif(F.regexp_extract(ticket_text, r"-(\d+)$", 1), F.lit("")).try_cast("bigint")


def ticket_date(ticket_text: str) -> str:
    """``yyyy-MM-dd`` of a ticket."""
    day = ticket_text.split("-")[1]
    return f"{day[:4]}-{day[4:6]}-{day[6:8]}"


def evidence_envelope(exports: DataFrame) -> DataFrame:
    """Flat exports -> nested v1 records."""
    known = set(exports.columns)
    col = lambda name, kind="string": F.col(name) if name in known else F.lit(None).cast(kind)
    content = F.coalesce("content", F.lit(""))
    return exports.select(
        *[c for c in ("account",) if c in known],
        F.lit(W.EVIDENCE_SCHEMA).alias("schema"),
        "ticket",
        F.coalesce(F.col("created_at").cast("bigint"), F.lit(0)).alias("created_at"),
        F.struct(
            F.coalesce(col("kind"), F.lit("unknown")).alias("kind"),
            F.coalesce(col("title"), F.lit("")).alias("title"),
            col("path").alias("path"),
        ).alias("source"),
        F.struct(
            F.lit("text/plain").alias("media_type"),
            F.lit("utf-8").alias("encoding"),
            content.alias("content"),
            F.octet_length(content).cast("bigint").alias("byte_count"),
        ).alias("payload"),
        F.struct(
            F.lit(W.PRODUCER).alias("addon_name"), *[col(c).cast("string").alias(c) for c in ENVIRONMENT[1:]]
        ).alias("environment"),
        (F.col("metadata") if "metadata" in known else F.when(col("path").isNotNull(), F.create_map(F.lit("path"), col("path"))).otherwise(F.create_map().cast("map<string,string>"))).alias("metadata"),
    )


# Input of ``evidence_migrate``: v1 columns, the flat v0 columns, and unknown fields kept as they are.
STORED = """account string, ticket string, schema string, created_at string,
    source struct<kind:string,title:string,path:string>,
    payload struct<media_type:string,encoding:string,content:string,byte_count:bigint>,
    environment struct<addon_name:string,client_id:string,version:string,build:string,build_date:string,interface:string,locale:string>,
    metadata map<string,string>, kind string, title string, content string, byte_count bigint,
    client struct<client_id:string,version:string,build:string,build_date:string,interface:string,locale:string>,
    extra map<string,string>"""


def evidence_migrate(records: DataFrame, max_entries: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Bring stored records of either version to v1; rows without text content are dropped.

    Metadata stay whole unless bounds are given: then the first ``max_entries`` keys and ``max_bytes`` of each
    value are kept, and ``metadata_cut`` tells which records lost something. Running it again changes nothing.
    """
    v1 = F.col("payload.content").isNotNull()
    content = F.coalesce("payload.content", "content")
    held = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    bounded = F.map_from_entries(F.slice(F.array_sort(F.map_entries(held)), 1, max_entries)) if max_entries is not None else held
    cut = F.size(held) > F.size(bounded)
    if max_bytes is not None:
        cut = cut | F.exists(F.map_values(held), lambda v: F.octet_length(v) > max_bytes)
        bounded = F.transform_values(bounded, lambda _, v: byte_truncate(v, max_bytes, ""))
    path = F.coalesce("source.path", F.try_element_at(bounded, F.lit("path")))
    env = lambda c: F.when(v1, F.col(f"environment.{c}")).otherwise(F.col(f"client.{c}")).alias(c)
    return records.filter(content.isNotNull() & F.col("ticket").isNotNull()).select(
        "account",
        F.when(v1, F.coalesce("schema", F.lit(W.EVIDENCE_SCHEMA))).otherwise(F.lit(W.EVIDENCE_SCHEMA)).alias("schema"),
        "ticket",
        F.coalesce(F.col("created_at").try_cast("bigint"), F.lit(0)).cast("string").alias("created_at"),
        F.struct(
            F.coalesce(F.when(v1, F.col("source.kind")).otherwise(F.col("kind")), F.lit("unknown")).alias("kind"),
            F.coalesce(F.when(v1, F.col("source.title")).otherwise(F.col("title")), F.lit("")).alias("title"),
            path.alias("path"),
        ).alias("source"),
        F.struct(
            F.when(v1, F.coalesce("payload.media_type", F.lit("text/plain"))).otherwise("text/plain").alias("media_type"),
            F.when(v1, F.coalesce("payload.encoding", F.lit("utf-8"))).otherwise("utf-8").alias("encoding"),
            content.alias("content"),
            F.octet_length(content).cast("bigint").alias("byte_count"),
        ).alias("payload"),
        F.struct(
            F.coalesce(F.when(v1, F.col("environment.addon_name")), F.lit(W.PRODUCER)).alias("addon_name"),
            *[env(c) for c in ENVIRONMENT[1:]],
        ).alias("environment"),
        bounded.alias("metadata"),
        *([] if max_entries is None and max_bytes is None else [F.coalesce(cut, F.lit(False)).alias("metadata_cut")]),
        *[F.lit(None).cast("string").alias(c) for c in ("kind", "title", "content")],
        F.lit(None).cast("bigint").alias("byte_count"),
        F.lit(None).cast("struct<client_id:string,version:string,build:string,build_date:string,interface:string,locale:string>").alias("client"),
        "extra",
    )


METADATA_ENTRIES = 32
METADATA_BYTES = 2048


def metadata_bound(
    metadata: DataFrame, column: str = "metadata", max_entries: int | None = METADATA_ENTRIES, max_bytes: int | None = METADATA_BYTES
) -> DataFrame:
    """Flat form of a JSON metadata column: the other columns with key_path, type, text and ``truncated`` per entry.

    Numbers and booleans are kept, maps followed for one level below the top, everything else dropped. Of
    each map the first ``max_entries`` kept keys stay, of each string ``max_bytes`` bytes; None keeps all. The flag tells
    for each entry whether its map had more keys or its text was cut. All of it happens inside a record's
    own row, whatever its other columns are called.
    """
    base = [c for c in metadata.columns if c != column]
    top = _kept_entries(F.expr(f"try_parse_json(`{column}`)"), F.lit(""), True, max_entries)
    level1 = metadata.select(*[F.col(f"`{c}`") for c in base], F.explode(top).alias("_e"))
    inner = _kept_entries(F.col("_e.value"), F.concat(F.col("_e.key_path"), F.lit(".")), False, max_entries)
    none = F.filter(F.array("_e"), lambda _: F.lit(False))
    both = F.concat(F.array("_e"), F.coalesce(F.when(F.col("_e.type") == "map", inner), none))
    rows = level1.select(*[F.col(f"`{c}`") for c in base], F.explode(both).alias("_e"))
    raw = F.when(F.col("_e.type") != "map", F.expr("try_variant_get(_e.value, '$', 'string')"))
    text = raw if max_bytes is None else _bound(raw, lambda t: byte_truncate(t, max_bytes, ""))
    cut = F.lit(False) if max_bytes is None else F.coalesce(F.octet_length(raw) > max_bytes, F.lit(False))
    return rows.select(
        *[F.col(f"`{c}`") for c in base],
        F.col("_e.key_path").alias("key_path"),
        F.col("_e.type").alias("type"),
        F.when(F.col("_e.type") == "map", "").otherwise(text).alias("text"),
        (F.col("_e.more") | cut).alias("truncated"),
    )


def _kept_entries(value: Column, prefix: Column, maps: bool, most: int | None) -> Column:
    """The entries of an object variant that can be kept, by key, as an array of (key_path, type, value, more)."""

    def typed(key, found):
        kind = _bound(
            F.call_function("schema_of_variant", found),
            lambda shape: F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
            .when(shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"), "number")
            .when(F.lit(maps) & shape.startswith("OBJECT"), "map"),
        )
        return F.struct(F.concat(prefix, key).alias("key_path"), kind.alias("type"), found.alias("value"))

    def by_key(entries):
        # variants have no order: sort the keys and look each value up by its place
        places = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"))))
        return F.filter(F.transform(places, lambda k: typed(k["key"], F.get(entries, k["at"])["value"])), lambda e: e["type"].isNotNull())

    def first(kept):
        more = F.lit(False) if most is None else F.size(kept) > most
        return F.transform(kept if most is None else F.slice(kept, 1, most), lambda e: F.struct(e["key_path"], e["type"], e["value"], more.alias("more")))

    fields = F.call_function("try_variant_get", value, F.lit("$"), F.lit("map<string,variant>"))
    return _bound(F.map_entries(fields), lambda entries: _bound(by_key(entries), first))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once: a lambda's argument is, a column that is named again is not."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def evidence_prune(records: DataFrame, max_bytes: int = W.STORE_BYTES, max_records: int = W.STORE_RECORDS) -> DataFrame:
    """The newest records of each account within both budgets.

    Only the newest ``max_records`` can stay, so the running byte sum sees no more than those.
    """
    order = [F.col("created_at").desc(), F.col("id").desc()]
    newest = top_per_key(records, ["account"], order, max_records, rank="position")
    upto = Win.partitionBy("account").orderBy("position").rowsBetween(Win.unboundedPreceding, 0)
    return newest.withColumn("running_bytes", F.sum(F.octet_length("content").cast("bigint")).over(upto)).filter(
        F.col("running_bytes") <= max_bytes
    )


def evidence_stats(records: DataFrame, budget: int = W.STORE_BYTES) -> DataFrame:
    return records.groupBy("account").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes")
    ).withColumn("budget", F.lit(budget).cast("bigint"))


def evidence_recent(records: DataFrame) -> DataFrame:
    return records.orderBy(F.col("created_at").desc(), F.col("ticket").asc())


RECORD = ["account", "ticket"]  # what names a record: tickets are counted per account and repeat across accounts


def evidence_get(store: DataFrame, account: str, ticket_text: str) -> DataFrame:
    """The record of one account's ticket; the date in the ticket prunes a store partitioned by ``created_date``."""
    hit = store.filter((F.col("account") == account) & (F.col("ticket") == ticket_text))
    if "created_date" in store.columns:
        hit = hit.filter(F.col("created_date") == ticket_date(ticket_text))
    return hit


def evidence_delete(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Records without those whose account and ticket are listed."""
    return records.join(tombstones.select(*RECORD), RECORD, "left_anti")


def evidence_pending(created: DataFrame, persisted: DataFrame) -> DataFrame:
    """Tickets handed out to an account but not in its store yet."""
    return created.join(persisted.select(*RECORD), RECORD, "left_anti")


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("account").agg(F.count(F.lit(1)).alias("pending"))


def order_reconcile(order: DataFrame, records: DataFrame) -> DataFrame:
    """Rebuild the order list of each account from what exists.

    Listed tickets that exist count once, existing ones missing from the list are
    added; newest first, ties by ticket.
    """
    listed = order.groupBy("account", "ticket").agg(F.min("position").alias("_listed"))
    present = records.select("account", "ticket", "created_at").join(listed, ["account", "ticket"], "left")
    order = [-F.col("created_at"), F.col("ticket")]
    marked = present.withColumn("was_listed", F.col("_listed").isNotNull()).drop("_listed")
    return running_total(marked, ["account"], order, chunk_of(records, order), F.lit(1), "position")


def export_chunks(records: DataFrame, size: int = W.OUTPUT_BYTES) -> DataFrame:
    """Consecutive byte ranges of each record's content; joined in order they give the content back."""
    raw = F.col("content").cast("binary")
    count = F.ceil(F.octet_length("content") / F.lit(float(size))).cast("int")
    numbered = records.filter(F.octet_length("content") > 0).select(
        *RECORD, "content", F.explode(F.sequence(F.lit(1), count)).alias("chunk_no")
    )
    return numbered.select(*RECORD, "chunk_no", F.substring(raw, (F.col("chunk_no") - 1) * size + 1, F.lit(size)).alias("chunk"))
