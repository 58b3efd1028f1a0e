"""JSON documents: node rows from VARIANT, canonical text, trees from serialised text."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.wording import CUT_OUTPUT, NODE_VALUE_BYTES
from fieldscope.functions.text import byte_truncate, quoted
from fieldscope.operators import json_index
from fieldscope.plans.spread import spread

# The helpers below run on executors that may not have this package installed: they are sent
# by value and refer to values of other modules, never to the modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _head(docs: DataFrame, keys: list[str]) -> str:
    """The columns that are carried along, as a schema."""
    return docs.select(*keys).schema.simpleString().removeprefix("struct<").removesuffix(">")


def _normal(kind: Column, raw: Column) -> Column:
    """The raw value with numbers as Spark's VARIANT prints them."""
    number = F.call_function("try_variant_get", F.call_function("try_parse_json", raw), F.lit("$"), F.lit("string"))
    return F.when(kind == "number", F.coalesce(number, raw)).otherwise(raw)


def variant_nodes(
    docs: DataFrame,
    doc_id: str,
    json_column: str,
    max_depth: int | None = None,
    max_entries: int | None = None,
    max_nodes: int | None = None,
    value_bytes: int | None = NODE_VALUE_BYTES,
) -> DataFrame:
    """Pre-order node rows of one JSON document per row.

    Documents are read in one pass over a batch's bytes, so the plan is the same and work is linear at any depth; a node's path is
    as long as it is deep. Bounds are the caller's and ``truncated`` tells of them; the value shown is cut at
    ``value_bytes`` (None: whole), ``bytes`` is the size of the raw value of a string. A document that is not valid JSON,
    or names a key of an object twice, has no nodes.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in json_index.slices(batch.column(1)):
                nodes = json_index.nodes_of(data, offsets, max_depth, max_entries, max_nodes)
                ids = batch.column(0).take(pa.array(nodes.doc + first))
                numeric = pa.array(nodes.numeric, mask=nodes.depth == 0)
                columns = [ids, pa.array(nodes.position, pa.int32()), pa.array(nodes.depth, pa.int32()), json_index.paths(nodes), numeric, nodes.kind, nodes.raw, pa.array(nodes.cut[nodes.doc])]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "position", "depth", "path", "numeric_key", "kind", "raw", "truncated"])

    chosen = spread(docs.select(F.col(doc_id).alias("_id"), F.col(json_column).cast("string").alias("_json")))
    schema = _head(chosen, ["_id"]) + ",position:int,depth:int,path:array<string>,numeric_key:boolean,kind:string,raw:string,truncated:boolean"
    kind, raw = F.col("kind"), _normal(F.col("kind"), F.col("raw"))
    shown = F.when(kind == "table", "Table").when(kind == "string", quoted(raw)).when(kind == "nil", "nil").otherwise(raw)
    return chosen.mapInArrow(flat, schema).select(
        F.col("_id").alias(doc_id.split(".")[-1]),
        "position",
        "depth",
        "path",
        "numeric_key",
        "kind",
        (shown if value_bytes is None else byte_truncate(shown, value_bytes, "...")).alias("value"),
        F.when(kind == "string", F.octet_length("raw")).alias("bytes"),
        "truncated",
    )


def _nodes_in_rows(docs: DataFrame, doc_id: str, json_column: str, max_depth: int | None, max_entries: int | None) -> DataFrame:
    """(_id, _cut, _all): each document's nodes in pre-order, in its row. ``ends`` has what was left out of the tables that end after a node."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in json_index.slices(batch.column(1)):
                nodes = json_index.nodes_of(data, offsets, max_depth, max_entries)
                roots = np.flatnonzero(nodes.parent < 0)
                numeric = pa.array(nodes.numeric)
                parts = [pa.array(nodes.depth, pa.int32()), nodes.key.cast(pa.string()), numeric, nodes.kind, nodes.raw, json_index.endings(nodes)]
                rows = pa.StructArray.from_arrays(parts, ["depth", "key", "numeric", "kind", "raw", "ends"])
                whole = nodes.doc[roots]
                lists = pa.ListArray.from_arrays(pa.array(np.append(roots, len(nodes.doc)), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whole + first)), pa.array(nodes.cut[whole]), lists], ["_id", "_cut", "_all"])

    chosen = spread(docs.select(F.col(doc_id).alias("_id"), F.col(json_column).cast("string").alias("_json")))
    node = "struct<depth:int,key:string,numeric:boolean,kind:string,raw:string,ends:array<int>>"
    return chosen.mapInArrow(flat, _head(chosen, ["_id"]) + f",_cut:boolean,_all:array<{node}>")


def document_scan(documents: DataFrame, declared: DataFrame) -> DataFrame:
    """Persistent documents (``owner``, ``name``, ``content``) that their owner declares.

    A declared name without a document stays, with null content.
    """
    return declared.select("owner", "name").distinct().join(documents, ["owner", "name"], "left")


def document_footprint(documents: DataFrame, max_depth: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Structural bytes of each declared document (``owner``, ``name``, ``content``).

    Sizes are those of the raw values. One that was never created, or is no JSON, counts as a single empty value of 8
    bytes. Bounds are the caller's; ``truncated`` tells where one left something out.
    """
    keyed = documents.withColumn("_doc", F.struct("owner", "name"))
    nodes = variant_nodes(
        keyed.filter("content IS NOT NULL"), "_doc", "content", None if max_depth is None else max_depth + 1,
        max_entries, None if max_entries is None else max_entries + 1,
    )
    key = F.element_at("path", -1)
    inside = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    entry = F.when(F.col("depth") > 0, 1).otherwise(0)
    size = F.when(F.col("kind") == "string", F.col("bytes")).when(F.col("kind") == "table", 48).otherwise(8)
    key_size = F.when(F.col("depth") == 0, 0).when(F.col("numeric_key"), 8).otherwise(F.octet_length(key))
    deeper = F.lit(False) if max_depth is None else F.max("depth") > max_depth
    sums = nodes.groupBy("_doc").agg(
        F.sum(entry * 16 + F.when(inside, size + key_size).otherwise(0)).cast("bigint").alias("bytes"),
        F.count_if(inside & (F.col("kind") == "table")).alias("tables"),
        F.sum(entry).cast("bigint").alias("entries"),
        (F.count_if(inside & (F.col("kind") == "string")) + F.count_if(inside & (F.col("depth") > 0) & ~F.col("numeric_key"))).alias("strings"),
        (F.bool_or("truncated") | deeper).alias("truncated"),
    ).select("_doc.owner", "_doc.name", "bytes", "tables", "entries", "strings", "truncated")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("owner", "name", F.col("content").isNotNull().alias("loaded")).join(sums, ["owner", "name"], "left").select(
        "owner", "name", "loaded", F.coalesce("bytes", F.lit(8)).alias("bytes"), zero("tables"), zero("entries"), zero("strings"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def _number_text(raw: Column) -> Column:
    """A JSON number as C's ``%.14g`` prints it, ties away from zero; whole numbers as they are."""
    digits = F.format_string("%.13e", raw.try_cast("double"))
    sign = F.when(digits.startswith("-"), "-").otherwise("")
    parts = F.regexp_extract(digits, r"^-?(\d)\.(\d+)e", 1), F.regexp_extract(digits, r"^-?(\d)\.(\d+)e", 2)
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).try_cast("int")
    all_digits = F.concat(*parts)
    kept = F.regexp_replace(all_digits, "0+$", "")
    point = lambda whole, rest: F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    large = point(F.substring(all_digits, F.lit(1), power + 1), F.regexp_replace(F.substring(all_digits, power + 2, F.lit(14)), "0+$", ""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), kept)
    scientific = F.concat(
        point(parts[0], F.substring(kept, F.lit(2), F.lit(14))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    shown = F.when(kept == "", "0").when((power >= 0) & (power < 14), large).when((power < 0) & (power >= -4), small).otherwise(scientific)
    return F.when(raw.rlike(r"^-?\d+$"), raw).otherwise(F.concat(sign, shown))


def canonical_documents(
    docs: DataFrame, doc_id: str, json_column: str, max_depth: int | None = None, max_entries: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """(doc_id, text, truncated): each JSON document as text with sorted keys, so that equal documents give equal text.

    The text is put together in the document's row from its nodes in pre-order: what each node opens, and what ends
    after it. Bounds are the caller's; a marker stands where one left something out, and ``truncated`` tells of it.
    No row for what is not valid JSON.
    """
    ordered = _nodes_in_rows(docs, doc_id, json_column, max_depth, max_entries)

    def indent(depth):
        return F.repeat(F.lit("  "), depth)

    def omitted(count, depth):
        return F.when(count > 0, F.concat(F.lit("\n"), indent(depth + 1), F.lit("... <"), count.cast("string"), F.lit(" entries omitted>"))).otherwise("")

    def piece(node):
        depth, kind = node["depth"], node["kind"]
        raw = _normal(kind, node["raw"])
        key = F.when(node["numeric"], node["key"]).otherwise(quoted(node["key"]))
        lead = F.when(depth > 0, F.concat(F.lit("\n"), indent(depth), F.lit("["), key, F.lit("] = "))).otherwise("")
        scalar = F.when(kind == "string", quoted(raw)).when(kind == "nil", "nil").when(kind == "boolean", raw).otherwise(_number_text(raw))
        comma = lambda d: F.when(d > 0, ",").otherwise("")
        end = lambda count, i: F.concat(omitted(count, depth - 1 - i), F.lit("\n"), indent(depth - 1 - i), F.lit("}"), comma(depth - 1 - i))
        empty = F.lit("{}") if max_depth is None else F.when(depth >= max_depth, "<max depth>").otherwise("{}")
        closed = F.concat(lead, F.when(kind == "table", empty).otherwise(scalar), comma(depth), F.array_join(F.transform(node["ends"], end), ""))
        return F.when(node["opens"], F.concat(lead, F.lit("{"))).otherwise(closed)

    # A table is opened where the next node lies below it.
    below = lambda n, i: n.withField("opens", F.coalesce(F.get("_all", i + 1)["depth"] > n["depth"], F.lit(False)))
    pieces = F.transform(F.transform("_all", below), piece)
    texts = ordered.select(F.col("_id").alias(doc_id.split(".")[-1]), F.array_join(pieces, "").alias("text"), F.col("_cut").alias("truncated"))
    doc_id = doc_id.split(".")[-1]
    if max_bytes is None:
        return texts
    long = F.octet_length("text") > max_bytes
    return texts.select(doc_id, byte_truncate(F.col("text"), max_bytes, CUT_OUTPUT).alias("text"), (F.col("truncated") | long).alias("truncated"))


def fingerprints(docs: DataFrame, doc_id: str, json_column: str) -> DataFrame:
    """Distinct documents by their whole canonical text: fingerprint, first id, copies."""
    return (
        canonical_documents(docs, doc_id, json_column)
        .select(doc_id, F.sha2("text", 256).alias("fingerprint"), F.octet_length("text").alias("bytes"))
        .groupBy("fingerprint")
        .agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"))
    )


# Tokens of serialised text after white space, which is never given back: a quoted string, a marker line, punctuation, or a bare word.
SPACE = " \t\r\n"
TOKEN = re.compile(
    r"""[ \t\r\n]*+(?:(?P<mark>[\[\]{},=])|(?P<quoted>"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')|(?P<marker>\.\.\.[^\r\n]*)|(?P<word>[^,\r\n{}\[\]="']+))""",
    re.S,
)
ROOT = re.compile(r"(?:^|\n)\[1\]\s*=")

IDENTIFIER = re.compile(r"[_A-Za-z]\w*")
NODE_ROWS = 20_000  # nodes that are handed on at once
PATH_STEPS = 500_000  # keys of their paths
NODE_SCHEMA = pa.schema(
    [("position", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("cut", pa.bool_())]
)
PATH = pa.field("path", pa.list_(pa.string()))


class _Malformed(Exception):
    pass


def _tokens(text: str):
    at = 0
    for found in TOKEN.finditer(text):
        if found.start() != at:  # something that is no token was passed over
            raise _Malformed
        at = found.end()
        kind = found.lastgroup
        yield kind, found[kind]
    if text[at:].strip(SPACE):
        raise _Malformed


def _scalar_kind(token: str) -> str:
    if token == "nil":
        return "nil"
    if token in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"[+-]?(0[xX][0-9a-fA-F]+|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", token):
        return "number"
    return "marker" if token.startswith("<") else "string"


def parse_tree(text: str | None, max_nodes: int | None = None) -> list[tuple[int, int, str, str, str]] | None:
    """Serialised values ``[1] = ...`` -> (parent, depth, key, kind, value) rows in pre-order; None if malformed or larger than ``max_nodes``.

    Open tables wait on a stack of their own, so depth is bounded by the text alone.
    """
    start = ROOT.search(text or "")
    if not start:
        return None
    rows: list[tuple[int, int, str, str, str]] = []
    open_tables: list[list[int]] = []  # row and entries so far of each table around the place
    try:
        stream = [*_tokens(text[start.start():].lstrip("\n")), ("end", "")]
    except _Malformed:
        return None
    at = 0

    def key() -> str:
        nonlocal at
        (_, opened), (kind, token), closed, equals = stream[at : at + 4]
        if opened != "[" or kind not in ("quoted", "word") or closed != ("mark", "]") or equals != ("mark", "="):
            raise _Malformed
        at += 4
        inner = token.strip()
        if kind == "quoted" and IDENTIFIER.fullmatch(inner[1:-1]):
            return inner[1:-1]
        return f"[{inner}]"

    def value(name: str) -> None:
        nonlocal at
        if max_nodes is not None and len(rows) >= max_nodes:
            raise _Malformed
        kind, token = stream[at]
        parent = open_tables[-1][0] if open_tables else -1
        if (kind, token) == ("mark", "{"):
            open_tables.append([len(rows), 0])
            rows.append((parent, len(open_tables) - 1, name, "table", ""))
        elif kind in ("quoted", "word"):
            rows.append((parent, len(open_tables), name, _scalar_kind(token.strip()), token.strip()))
        else:
            raise _Malformed
        at += 1

    try:
        index = 1
        while open_tables or stream[at] == ("mark", "["):
            if not open_tables:
                if key() != f"[{index}]":
                    break
                index += 1
                value(f"[{index - 1}]")
                continue
            kind, token = stream[at]
            if (kind, token) == ("mark", "}"):
                mine, entries = open_tables.pop()
                rows[mine] = (*rows[mine][:4], f"Table ({entries} entries)")
                at += 1
            else:
                open_tables[-1][1] += 1
                if kind == "marker":
                    rows.append((open_tables[-1][0], len(open_tables), "...", "marker", token.strip()))
                    at += 1
                    continue
                depth = len(open_tables)
                value(key())
                if len(open_tables) > depth:
                    continue
            if open_tables and stream[at] == ("mark", ","):
                at += 1
    except (_Malformed, IndexError, ValueError):  # also where the text ends too early
        return None
    return rows or None


def tree_from_text(
    entries: DataFrame, text_column: str, keys: list[str], max_nodes: int | None = None, value_bytes: int | None = None, paths: bool = True
) -> DataFrame:
    """Node rows of the serialised text of each entry, in pre-order; malformed text, or one of more than ``max_nodes`` nodes, has none.

    ``parent`` is the position of the table around a node, ``path`` its keys from the root down. A path is as long as its node is deep, so
    that texts of great depth are better read without (``paths``). Values are whole unless ``value_bytes`` cuts them; ``cut``
    tells where. Rows are handed on in batches of bounded size.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            steps = 0
            for owner, text in enumerate(batch.column(text_column).to_pylist()):
                way: list[str] = []
                for position, (parent, depth, key, kind, value) in enumerate(parse_tree(text, max_nodes) or ()):
                    del way[depth:]
                    way.append(key)
                    raw = value.encode() if value_bytes is not None and len(value) * 4 > value_bytes else b""
                    cut = value_bytes is not None and len(raw) > value_bytes
                    shown = raw[:value_bytes].decode(errors="ignore") + "..." if cut else value
                    held.append((owner, position, parent if parent >= 0 else None, depth, key, kind, shown, cut, tuple(way) if paths else None))
                    steps += depth + 1
                    if len(held) >= NODE_ROWS or (paths and steps >= PATH_STEPS):
                        yield made(batch, held)
                        held, steps = [], 0
            yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        owner, *columns = zip(*held) if held else ((),) * (len(NODE_SCHEMA) + 2)
        carried = [batch.column(k).take(pa.array(owner, pa.int64())) for k in keys]
        fields = [f for f in [*NODE_SCHEMA, PATH] if paths or f is not PATH]
        return pa.RecordBatch.from_arrays([*carried, *(pa.array(c, f.type) for c, f in zip(columns, fields))], [*keys, *(f.name for f in fields)])

    chosen = spread(entries.select(*keys, text_column))
    schema = _head(chosen, keys) + ",position:int,parent:int,depth:int,key:string,kind:string,value:string,cut:boolean"
    return chosen.mapInArrow(parse, schema + (",path:array<string>" if paths else ""))
