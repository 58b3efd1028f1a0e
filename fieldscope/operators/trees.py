"""Nested documents as node tables: flattening, sizes, search, paths, pages.

A node table has one row per node: ``id``, ``parent_id`` (null for a document's
root), ``key``, ``kind`` (table, string, number, boolean, function, ...), ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from fieldscope.functions import wording as W
from fieldscope.functions.text import byte_truncate, quoted
from fieldscope.plans import bucket_of, running_total, split_points, top_per_key
from fieldscope.plans.spread import spread
from fieldscope.session import pin

IDENTIFIER = "^[_A-Za-z][_A-Za-z0-9]*$"


def _walked(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, up, chain, cyclic): the way up from each node. ``up`` is null where it has ended at a root or on a cycle.

    Pointers are doubled: after round r a row knows 2^r ancestors. Each round is written to the shared folder, so
    the plan does not grow. Rows that are done take part under their own id, which spreads them. Nodes below a
    missing parent are dropped.
    """
    step = F.struct("id", "key")
    state = pin(spread(nodes.select("id", "parent_id", "key")).select("id", F.col("parent_id").alias("up"), F.array(step).alias("chain"), F.lit(False).alias("cyclic")), "ancestry")
    reach = 1
    while (max_depth is None or reach < max_depth + 2) and not state.filter(F.col("up").isNotNull()).isEmpty():
        upper = state.select(F.col("id").alias("_id"), F.col("up").alias("_next"), F.col("chain").alias("_above"), F.col("cyclic").alias("_round"))
        lower = state.withColumn("_key", F.coalesce("up", "id"))
        joined = lower.join(upper, (F.col("_key") == F.col("_id")) & F.col("up").isNotNull(), "left")
        moved = joined.filter(F.col("up").isNull() | F.col("_id").isNotNull()).select(
            "id",
            F.when(F.col("up").isNotNull(), F.col("_next")).alias("up"),
            F.when(F.col("up").isNotNull(), F.concat("_above", "chain")).otherwise(F.col("chain")).alias("chain"),
            (F.col("cyclic") | F.coalesce("_round", F.lit(False))).alias("cyclic"),
        )
        ids = F.transform("chain", lambda c: c["id"])
        again = (F.size(F.array_distinct(ids)) < F.size(ids)) | F.coalesce(F.array_contains(ids, F.col("up")), F.lit(False))
        state = pin(
            moved.withColumn("cyclic", F.col("cyclic") | again).withColumn("up", F.when(~F.col("cyclic"), F.col("up"))), "ancestry"
        )
        reach *= 2
    return state


def ancestry(nodes: DataFrame, max_depth: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Add ``chain``: the (id, key) pairs from the root down to the node itself, and ``depth``.

    All nodes that hang below a root; with ``max_depth`` those down to one level further, so that a caller
    can tell that there are deeper ones. Nodes on or below a cycle have no root: see ``cyclic_nodes``.
    """
    rooted = _walked(nodes, max_depth).filter(F.col("up").isNull() & ~F.col("cyclic"))
    if max_depth is not None:
        rooted = rooted.filter(F.size("chain") <= max_depth + 2)
    placed = spread(nodes.select("id", "parent_id", "key", "kind", "value", *extra)).join(rooted.select("id", "chain"), "id")
    return placed.withColumn("depth", F.size("chain") - 1)


def cyclic_nodes(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, key, kind, marker) of the nodes on or below a cycle, which no tree view can place."""
    found = _walked(nodes).filter("cyclic").select("id")
    return nodes.join(found, "id", "left_semi").select("id", "parent_id", "key", "kind", F.lit(W.CYCLE).alias("marker"))


def key_path() -> Column:
    return F.transform("chain", lambda c: c["key"])


def key_order(key: Column) -> Column:
    """Whole numbers by value, before all other keys by text."""
    number = F.when(key.rlike(r"^-?\d{1,18}$"), key.try_cast("bigint"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), key.alias("key"))


def path_order() -> Column:
    """Pre-order of the nodes of one document: their keys from the root down, numbers by value; ids part equal keys."""
    return F.transform("chain", lambda c: F.struct(key_order(c["key"]).alias("key"), c["id"].alias("id")))


def tree_flatten(
    nodes: DataFrame, max_depth: int | None = None, max_entries: int | None = None, max_nodes: int | None = None
) -> DataFrame:
    """Pre-order node rows of every document.

    Bounds are the caller's: depth, entries per table (first by key), nodes per document (first in pre-order);
    ``truncated`` tells whether a bound cut something off the document.
    """
    bounded, wide = nodes, None
    if max_entries is not None:
        below = nodes.filter(F.col("parent_id").isNotNull())
        wide = below.groupBy("parent_id").agg((F.count(F.lit(1)) > max_entries).alias("wide")).filter("wide")
        first = top_per_key(below, ["parent_id"], [key_order(F.col("key")), F.col("id")], max_entries, rank="_r").drop("_r")
        bounded = nodes.filter(F.col("parent_id").isNull()).unionByName(first)
    placed = ancestry(bounded, max_depth).withColumn("doc_id", F.col("chain")[0]["id"]).withColumn("path", key_path())
    if wide is not None:
        placed = placed.join(wide.select(F.col("parent_id").alias("id"), "wide"), "id", "left")
    inside = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    flags = [F.lit(False)]
    flags += [] if wide is None else [F.coalesce(F.bool_or("wide"), F.lit(False))]
    flags += [] if max_depth is None else [F.max("depth") > max_depth]
    flags += [] if max_nodes is None else [F.count_if(inside) > max_nodes]
    cut = placed.groupBy("doc_id").agg(reduce(or_, flags).alias("truncated"))
    shown = placed.filter(inside).withColumn("_order", path_order())
    shown = shown if wide is None else shown.drop("wide")
    if max_nodes is None:
        # split by the top-level key, under which the rest of the order stays together
        kept = _numbered(shown.withColumn("_top", F.get("_order", F.lit(1))))
    else:
        kept = top_per_key(shown, ["doc_id"], [F.col("_order")], max_nodes, rank="position").drop("_order")
    return kept.join(cut, "doc_id").withColumn("value", byte_truncate(F.col("value"), W.NODE_VALUE_BYTES, "..."))


def _numbered(shown: DataFrame) -> DataFrame:
    """Positions in pre-order: counted per top-level branch first, so that a large document is not one window."""
    branch = ["doc_id", "_top"]
    sizes = shown.groupBy(*branch).agg(F.count(F.lit(1)).alias("_n"))
    before = Win.partitionBy("doc_id").orderBy(F.col("_top").asc_nulls_first()).rowsBetween(Win.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("doc_id").alias("_doc"), F.col("_top").alias("_branch"), "_base")
    ranked = shown.withColumn("_run", F.row_number().over(Win.partitionBy(*branch).orderBy("_order")))
    joined = ranked.join(bases, (F.col("doc_id") == F.col("_doc")) & F.col("_top").eqNullSafe(F.col("_branch")))
    return joined.withColumn("position", F.col("_run") + F.col("_base")).drop("_run", "_base", "_doc", "_branch", "_top", "_order")


def _label(key: Column) -> Column:
    return F.when(key.rlike(IDENTIFIER), key).otherwise(F.concat(F.lit("["), quoted(key), F.lit("]")))


def breadcrumb(path: Column) -> Column:
    """``root / child / ["other key"]``."""
    return F.array_join(F.transform(path, _label), " / ")


def access_path(path: Column) -> Column:
    """``a.b["other key"]``."""
    parts = F.transform(path, lambda k: F.when(k.rlike(IDENTIFIER), F.concat(F.lit("."), k)).otherwise(_label(k)))
    return F.regexp_replace(F.array_join(parts, ""), r"^\.", "")


def value_bytes(kind: Column, value: Column) -> Column:
    """Structural size of one value."""
    return (
        F.when(kind == "string", F.octet_length(value)).when(kind == "table", 48).when(kind == "function", 16).otherwise(8)
    )


def per_root(nodes: DataFrame, root_depth: int, max_depth: int | None = None) -> DataFrame:
    """Nodes at and below ``root_depth`` with their root and depth below it."""
    placed = ancestry(nodes, None if max_depth is None else max_depth + root_depth).filter(F.col("depth") >= root_depth)
    return placed.select(
        "id", "key", "kind", "value",
        F.col("chain")[root_depth]["id"].alias("root_id"),
        (F.col("depth") - root_depth).alias("below"),
        path_order().alias("path"),
    )


def footprint(nodes: DataFrame, root_depth: int = 1, max_depth: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Structural bytes and counts per root: values, 16 per entry, and the keys themselves.

    Bounds are the caller's; ``truncated`` tells where one left something out. An entry of a table at the
    depth limit still counts, its key and value do not.
    """
    rows = per_root(nodes, root_depth, max_depth)
    counted = rows
    if max_entries is not None:
        first = top_per_key(rows.filter("below > 0"), ["root_id"], [F.col("path")], max_entries, rank="_r").drop("_r")
        counted = rows.filter("below = 0").unionByName(first)
    inside = F.lit(True) if max_depth is None else F.col("below") <= max_depth
    entry = F.when(F.col("below") > 0, 1).otherwise(0)
    size = entry * 16 + F.when(inside, value_bytes(F.col("kind"), F.col("value")) + entry * F.octet_length("key")).otherwise(0)
    more = F.lit(False) if max_entries is None else F.count_if(F.col("below") > 0) > max_entries
    deeper = F.lit(False) if max_depth is None else F.max("below") > max_depth
    totals = rows.groupBy("root_id").agg((more | deeper).alias("truncated"))
    sums = counted.groupBy("root_id").agg(
        F.sum(size).cast("bigint").alias("bytes"),
        F.count_if(inside & (F.col("kind") == "table")).alias("tables"),
        F.sum(entry).cast("bigint").alias("entries"),
        (F.count_if(inside & (F.col("kind") == "string")) + F.count_if(inside & (entry == 1))).alias("strings"),
        F.count_if(inside & (F.col("kind") == "function")).alias("functions"),
    )
    return sums.join(totals, "root_id")


def graph_counts(nodes: DataFrame, root_depth: int = 1, max_depth: int | None = None) -> DataFrame:
    """Tables, functions, strings and entries below each root; ``truncated`` if ``max_depth`` left deeper ones out."""
    inside = F.lit(True) if max_depth is None else F.col("below") <= max_depth
    return per_root(nodes, root_depth, max_depth).groupBy("root_id").agg(
        F.count_if(inside & (F.col("kind") == "table")).alias("tables"),
        F.count_if(inside & (F.col("kind") == "function")).alias("functions"),
        F.count_if(inside & (F.col("kind") == "string")).alias("strings"),
        F.count_if(inside & (F.col("below") > 0)).alias("entries"),
        F.bool_or(~inside).alias("truncated"),
    )


def preview(kind: Column, value: Column) -> Column:
    shown = F.when(kind == "string", quoted(value)).when(kind == "table", "table").otherwise(value)
    return byte_truncate(shown, W.PREVIEW_BYTES, "...")


def _hits(placed: DataFrame, needle: Column) -> DataFrame:
    """Nodes whose key holds ``needle`` (lower case), with the kind of match."""
    at = F.call_function("instr", F.lower("key"), needle)
    match = F.when(F.lower("key") == needle, 1).when(at == 1, 2).when(at > 1, 3)
    return placed.withColumn("match", match).filter(F.col("match").isNotNull())


SEARCH_ORDER = ("match", "key", "path")
GRAM = 3


def key_search(placed: DataFrame, text: str, limit: int = 200, max_depth: int | None = None) -> DataFrame:
    """Keys holding ``text`` in any case: exact, then prefix, then inner matches, per document.

    ``placed`` is a flattened tree (``doc_id``, ``depth``, ``path``). All matches are ranked
    before the limit is applied; ``total_matches`` counts them all.
    """
    needle = text.strip().lower()
    if not needle:
        raise ValueError("a search text is required")
    below = F.col("depth") >= 1 if max_depth is None else F.col("depth").between(1, max_depth + 1)
    hits = _hits(placed.filter(below), F.lit(needle))
    totals = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_matches"))
    shown = top_per_key(hits, ["doc_id"], [F.col(c) for c in SEARCH_ORDER], limit)
    return shown.join(totals, "doc_id").select(
        "doc_id", "rank", "id", "key", F.col("path").alias("keys"), "kind", preview(F.col("kind"), F.col("value")).alias("preview"), "match", "total_matches"
    )


def _holding(keys: DataFrame, needles: DataFrame) -> DataFrame:
    """(low, needle): which of the lower-case keys hold which needles.

    Both are distinct. The places of a key where the first three letters of a needle stand (or all of a shorter one) are
    found by these letters; there, pieces as long as the needles that begin so are looked up whole. Needles that share
    their first letters are thus not tried one by one.
    """
    length = F.length("needle")
    asked = needles.filter(length > 0).select("needle", F.substring(F.col("needle"), F.lit(1), F.least(length, F.lit(GRAM))).alias("gram"), length.alias("size"))
    grams = asked.groupBy("gram").agg(F.collect_set("size").alias("sizes"))
    long = [row[0] for row in asked.select(F.length("gram")).distinct().collect()]  # three numbers at most

    def places(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("low"), i, F.lit(n)).alias("gram")))
        return F.when(F.length("low") >= n, each).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))

    parts = keys.select("low", F.explode(F.concat(*map(places, long), F.array().cast("array<struct<at:int,gram:string>>"))).alias("_p")).select("low", "_p.*")
    pieces = parts.join(grams, "gram").select("low", "at", F.explode("sizes").alias("size")).filter(F.col("at") + F.col("size") - 1 <= F.length("low"))
    pieces = pieces.select("low", F.substring(F.col("low"), F.col("at"), F.col("size")).alias("needle"), "at")
    # the first place of a needle stands for the others
    return pieces.filter(F.call_function("instr", F.col("low"), F.col("needle")) == F.col("at")).join(asked.select("needle"), "needle").select("low", "needle")


def _best(hits: DataFrame, search: list[str], limit: int) -> DataFrame:
    """The first matches of each search and how many it has."""
    totals = hits.groupBy(*search).agg(F.count(F.lit(1)).alias("total_matches"))
    shown = top_per_key(hits, search, [F.col(c) for c in SEARCH_ORDER], limit)
    return shown.join(totals, search).select(*search, "rank", "id", "key", "match", "total_matches")


def search_fallback(placed: DataFrame, queries: DataFrame, limit: int = 200, max_depth: int | None = None) -> DataFrame:
    """Answer each query (``query_id``, ``needle``, ``scope_id``) below its scope node, or, if nothing
    is found there, among the top-level keys of all documents.

    Any number of queries: needles are joined to the keys that hold them, each different search (a needle in a scope, a
    needle in all documents) is made once, and its first matches go to the queries that ask for it. An empty needle finds nothing.
    """
    asked = queries.select("query_id", F.lower(F.trim("needle")).alias("needle"), "scope_id")
    searches = asked.select("needle", "scope_id").distinct()
    keyed = placed.withColumn("low", F.lower("key"))
    found = pin(_holding(keyed.select("low").distinct(), asked.select("needle").distinct()), "holding")
    at = F.call_function("instr", F.col("low"), F.col("needle"))
    match = F.when(F.col("low") == F.col("needle"), 1).when(at == 1, 2).otherwise(3).alias("match")

    first = F.lit(1) if max_depth is None else F.greatest(F.lit(1), F.col("depth") - max_depth)
    above = F.transform(F.slice("chain", first, F.greatest(F.col("depth") + 1 - first, F.lit(0))), lambda c: c["id"])
    inside = keyed.select("id", "key", "path", "low", F.explode(above).alias("scope_id"))
    inside = inside.join(searches.select("scope_id").distinct(), "scope_id", "left_semi")
    near = inside.join(found, "low").join(searches, ["needle", "scope_id"]).select("needle", "scope_id", "id", "key", "path", match)
    near = pin(_best(pin(near, "near"), ["needle", "scope_id"], limit), "near-best")
    far = keyed.filter("depth = 1").join(found, "low").select("needle", "id", "key", "path", match)
    nothing = asked.join(near.select("needle", "scope_id").distinct(), ["needle", "scope_id"], "left_anti")

    told = lambda answers, scope: answers.select("query_id", F.lit(scope).alias("scope"), "rank", "id", "key", "match", "total_matches")
    return told(asked.join(near, ["needle", "scope_id"]), "local").unionByName(told(nothing.join(_best(far, ["needle"], limit), "needle"), "global"))


TYPE_RANK = {"secret": 0, "number": 1, "string": 2, "boolean": 3}


def canonical_key_order(keys: DataFrame, group: Sequence[str]) -> DataFrame:
    """Position of each key (``key_type``, ``number``, ``text``) in its group: secrets, numbers
    by value, strings, booleans (false first), everything else by text."""
    kind = F.col("key_type")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(p) for kv in TYPE_RANK.items() for p in kv]), kind), F.lit(4))
    ranked = keys.withColumn("_t", rank)
    texts = split_points(ranked.filter("_t = 2"), "text")
    numbers = split_points(ranked.filter("_t = 1"), "number")
    part = F.when(F.col("_t") == 2, bucket_of("text", texts)).when(F.col("_t") == 1, bucket_of("number", numbers)).otherwise(0)
    chunk = F.col("_t") * 1000 + part
    order = [F.col("_t"), F.col("number").asc_nulls_first(), F.col("text"), F.col("id")]
    return running_total(ranked, group, order, chunk, F.lit(1), "position").drop("_t")


def child_pages(children: DataFrame, page_size: int = 200) -> DataFrame:
    """Pages of each parent's children in key order (numbers by value, then texts), with how many are loaded by then."""
    typed = children.withColumn("_order", key_order(F.col("key")))
    numbers = bucket_of("_order.number", split_points(typed, "_order.number"))
    texts = bucket_of("key", split_points(typed.filter("_order.text"), "key"))
    chunk = F.when(F.col("_order.text"), texts + 1000).otherwise(numbers)
    placed = running_total(typed, ["parent_id"], [F.col("_order"), F.col("id")], chunk, F.lit(1), "position").drop("_order")
    totals = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    page = F.floor((F.col("position") - 1) / page_size)
    loaded = F.least((page + 1) * page_size, F.col("children"))
    return placed.join(totals, "parent_id").select(
        "parent_id", "id", "key", "position", page.alias("page"), loaded.alias("loaded_count"), (loaded < F.col("children")).alias("has_more")
    )


# Fixed value: what a member path looks like.
PATH = r"""^(\.?[_A-Za-z]\w*|\.?\[-?\d+\]|\.?\["[^"\]]+"\]|\.?\['[^'\]]+'\])(\.[_A-Za-z]\w*|\.?\[-?\d+\]|\.?\["[^"\]]+"\]|\.?\['[^'\]]+'\])*$"""
TOKEN = r"""([_A-Za-z]\w*|\[-?\d+\]|\["[^"\]]+"\]|\['[^'\]]+'\])"""


def path_tokens(path: Column) -> Column:
    """Member path -> typed tokens (``s:name`` or ``n:3``); null when malformed, empty for the root."""
    text = F.regexp_replace(path, r"^\s+|\s+$", "")
    text = F.when(text.startswith("_G."), F.substring(text, F.lit(4), F.length(text))).otherwise(text)
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)),
        lambda t: F.when(t.rlike(r"^\[-?\d"), F.concat(F.lit("n:"), F.regexp_extract(t, r"-?\d+", 0).cast("bigint").cast("string")))
        .when(t.startswith("["), F.concat(F.lit("s:"), F.substring(t, F.lit(3), F.length(t) - 4)))
        .otherwise(F.concat(F.lit("s:"), t)),
    )
    return F.when(text == "_G", F.array().cast("array<string>")).when(text.rlike(PATH), tokens)


def canonical_path(tokens: Column) -> Column:
    return F.array_join(tokens, "\u0001")


def path_resolve(requests: DataFrame, placed: DataFrame) -> DataFrame:
    """Look up requested paths (``request_id``, ``doc_id``, ``path``) in their document of a flattened tree by their canonical form.

    Keys that read as whole numbers answer to numeric tokens. Requests that cannot be read are answered without a lookup.
    """
    tokens = path_tokens(F.col("path"))
    empty = F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), r"\s", "") == ""
    # Paths are read once, and what was read is kept for both answers.
    read = requests.select("request_id", "doc_id", empty.alias("_empty"), tokens.alias("_tokens"))
    asked = pin(
        read.select(
            "request_id",
            "doc_id",
            F.when(F.col("_empty"), "path_required").when(F.col("_tokens").isNull(), "path_invalid").alias("reason"),
            canonical_path(F.col("_tokens")).alias("canonical"),
        ),
        "asked",
    )
    typed = F.transform("path", lambda k: F.concat(F.when(k.rlike(r"^-?\d+$"), "n:").otherwise("s:"), k))
    known = placed.select("doc_id", canonical_path(typed).alias("canonical"), "id", "kind")
    none = placed.select("id", "kind").schema
    unread = asked.filter(F.col("reason").isNotNull()).select(
        "request_id", "doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in none], F.col("reason").alias("status")
    )
    looked = asked.filter(F.col("reason").isNull()).join(known, ["doc_id", "canonical"], "left").select(
        "request_id", "doc_id", "id", "kind", F.when(F.col("id").isNull(), "not_found").otherwise("found").alias("status")
    )
    return looked.unionByName(unread)
