"""Nodes of JSON texts, from one pass over the bytes of a whole batch.

Tokens are found once for all documents of a batch: strings by the parity of their quotes, depth by a running sum over
brackets, the table around a token as the last bracket that opened the depth it stands in. Nothing recurses, and work grows
with the text, whatever its depth; a document of great depth costs only itself.
"""

from __future__ import annotations

import json
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# These run on executors that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 20  # bytes of documents that are taken together; a longer one stands alone
OPEN_MAP, OPEN_LIST, CLOSE_MAP, CLOSE_LIST, COMMA, COLON, STRING, SCALAR = range(1, 9)
MARKS = {ord(c): k for c, k in zip("{[}],:", range(1, 7))}
WELL_FORMED_STRING = r'^"([^\x00-\x1f\\"]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"$'
WELL_FORMED_SCALAR = r"^(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)$"


class Nodes(NamedTuple):
    """Nodes in the pre-order of their documents, tables' entries by key. ``parent`` and ``following`` are places in these arrays."""

    doc: np.ndarray  # the document's place in the slice
    position: np.ndarray
    depth: np.ndarray
    parent: np.ndarray  # -1 for a root
    key: pa.Array  # an object's key or the place in a list, from 1; null for a root
    numeric: np.ndarray
    kind: pa.Array
    raw: pa.Array  # a string without quotes and escapes, or the text of a number or boolean
    left_out: np.ndarray  # a table's entries beyond the bound
    cut: np.ndarray  # per document of the slice: a bound left something out


def slices(texts: pa.Array):
    """(first, end, bytes, offsets) of stretches of documents; a null text is empty."""
    column = texts.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, upto, raw[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of ascending spans that do not overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    borders = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(borders), pa.py_buffer(kept))


def _unquoted(tokens: pa.Array) -> pa.Array:
    """Strings without their quotes and escapes; halves of surrogate pairs that stand alone become question marks."""
    plain = pc.utf8_slice_codeunits(tokens, 1, -1)
    escaped = np.flatnonzero(pc.match_substring(tokens, "\\").to_numpy(zero_copy_only=False))
    if not len(escaped):
        return plain
    made = [json.loads(t).encode("utf-8", "replace").decode() for t in tokens.take(pa.array(escaped)).to_pylist()]
    mask = np.zeros(len(tokens), bool)
    mask[escaped] = True
    return pc.replace_with_mask(plain, pa.array(mask), pa.array(made, pa.large_string()))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, start, end of each token, and per document whether its strings end."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    slashes = np.flatnonzero(data == 92)
    quote = data == 34
    if len(slashes):
        first = np.ones(len(slashes), bool)
        first[1:] = (slashes[1:] != slashes[:-1] + 1) | begins[slashes[1:]]
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(slashes)))
        after = (slashes[at] + lengths)[lengths % 2 == 1]
        after = after[~begins[after] & (after < n)]
        quote[after] = False
    quotes = np.flatnonzero(quote)
    number = np.searchsorted(quotes, offsets)
    held = np.diff(number)
    opening = (np.arange(len(quotes)) - np.repeat(number[:-1], held)) % 2 == 0
    opens = quotes[opening]
    closes = np.full(len(opens), n)
    paired = np.ones(len(opens), bool)
    ends_of = np.repeat(offsets[1:], held)[opening]
    following = np.flatnonzero(opening) + 1
    paired = (following < len(quotes)) & ~np.append(opening, True)[following]
    closes = np.where(paired, np.append(quotes, n)[np.minimum(following, len(quotes))] + 1, ends_of)
    steps = np.zeros(n + 1, np.int8)
    steps[opens] += 1
    np.subtract.at(steps, closes, 1)
    outside = np.cumsum(steps[:-1], dtype=np.int8) == 0
    marks = np.zeros(256, np.uint8)
    for byte, kind in MARKS.items():
        marks[byte] = kind
    kinds = np.where(outside, marks[data], 0).astype(np.uint8)
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    bare = outside & ~blank & (kinds == 0)
    first = bare.copy()
    first[1:] &= ~bare[:-1] | begins[1:-1]
    last = bare.copy()
    last[:-1] &= ~bare[1:] | begins[1:-1]
    kinds[opens] = STRING
    kinds[first] = SCALAR
    starts = np.flatnonzero(kinds)
    kind = kinds[starts]
    ends = starts + 1
    ends[kind == STRING] = closes
    ends[kind == SCALAR] = np.flatnonzero(last) + 1
    return kind, starts, ends, held % 2 == 0


def _surrounding(kind: np.ndarray, after: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bracket that opened the depth each token stands in; -1 at the top."""
    opens = (kind == OPEN_MAP) | (kind == OPEN_LIST)
    token = np.repeat(np.arange(len(kind)), 1 + opens)
    opener = np.append(token[1:] == token[:-1], False)
    opener = np.concatenate(([False], opener[:-1])) if len(token) else opener
    order = np.argsort(np.where(opener, after[token], level[token]), kind="stable")
    latest = np.maximum.accumulate(np.where(opener[order], np.arange(len(order)), -1)) if len(order) else order
    out = np.full(len(kind), -1)
    own = ~opener[order]
    out[token[order[own]]] = token[order[np.maximum(latest[own], 0)]]
    out[level == 0] = -1
    return out


def nodes_of(data: np.ndarray, offsets: np.ndarray, max_depth: int | None = None, max_entries: int | None = None, max_nodes: int | None = None) -> Nodes:
    """All nodes of the documents that are JSON; a document that is not has none."""
    docs = len(offsets) - 1
    kind, start, end, sound = _tokens(data, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    good = sound.copy()
    delta = np.where(kind <= OPEN_LIST, 1, np.where(kind <= CLOSE_LIST, -1, 0))
    sums = np.concatenate(([0], np.cumsum(delta)))
    borders = np.searchsorted(doc, np.arange(docs + 1))
    after = sums[1:] - sums[borders[:-1]][doc]
    good &= (borders[1:] > borders[:-1]) & (sums[borders[1:]] == sums[borders[:-1]])
    good[doc[after < 0]] = False

    def chosen(mask, *columns):
        return [c[mask] for c in columns]

    kind, start, end, doc, after = chosen(good[doc], kind, start, end, doc, after)
    level = after - (kind <= OPEN_LIST) + ((kind == CLOSE_MAP) | (kind == CLOSE_LIST))
    around = _surrounding(kind, after, level)
    # The grammar, by each token's neighbour before and the table around it.
    place = np.arange(len(kind))
    has_before = np.concatenate(([False], doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, bool)
    before = np.where(has_before, np.concatenate(([0], kind[:-1]))[: len(kind)], 0)
    table = np.where(around >= 0, kind[around], 0)
    key = (kind == STRING) & (table == OPEN_MAP) & ((before == OPEN_MAP) | (before == COMMA))
    value = (kind <= OPEN_LIST) | (kind == SCALAR) | ((kind == STRING) & ~key)
    closing = (kind == CLOSE_MAP) | (kind == CLOSE_LIST)
    complete = closing | (kind == SCALAR) | ((kind == STRING) & ~key)
    complete_before = has_before & np.concatenate(([False], complete[:-1]))[: len(kind)]
    key_before = has_before & np.concatenate(([False], key[:-1]))[: len(kind)]
    in_list = (table == OPEN_LIST) & ((before == OPEN_LIST) | (before == COMMA))
    fits = key | (value & (((table == 0) & ~has_before) | ((table == OPEN_MAP) & (before == COLON)) | in_list))
    fits |= (kind == COLON) & key_before
    fits |= (kind == COMMA) & complete_before & (table != 0)
    fits |= closing & (table == kind - 2) & ((around == place - 1) | complete_before)
    good[doc[~fits]] = False
    for one, pattern in ((STRING, WELL_FORMED_STRING), (SCALAR, WELL_FORMED_SCALAR)):
        some = np.flatnonzero((kind == one) & good[doc])
        well = pc.match_substring_regex(_texts(data, start[some], end[some]), pattern).to_numpy(zero_copy_only=False).astype(bool)
        good[doc[some[~well]]] = False

    # Values are nodes; an object's entry has its key two tokens before it, a list's its number.
    keep = good[doc]
    moved = np.cumsum(keep) - 1
    around = np.where(around >= 0, moved[around], -1)[keep]
    kind, start, end, doc, level, key, value, closing = chosen(keep, kind, start, end, doc, level, key, value, closing)
    node = np.flatnonzero(value)
    number = np.cumsum(value) - 1
    parent = np.where(around[node] >= 0, number[around[node]], -1)
    depth, of = level[node], doc[node]
    listed = np.where(around[node] >= 0, kind[around[node]], 0) == OPEN_LIST
    named = (parent >= 0) & ~listed
    by_parent = np.argsort(parent, kind="stable")
    children = np.bincount(parent[parent >= 0], minlength=len(node))
    firsts = np.concatenate(([0], np.cumsum(np.bincount(parent + 1, minlength=len(node) + 1))))
    entry = np.empty(len(node), np.int64)
    entry[by_parent] = np.arange(len(node)) - firsts[parent[by_parent] + 1]

    at = node[named] - 2
    names = _unquoted(_texts(data, start[at], end[at])) if len(at) else pa.array([], pa.large_string())
    coded = names.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary.cast(pa.large_binary())).to_numpy()] = np.arange(len(rank))
    sorts = entry.copy()
    sorts[named] = rank[coded.indices.to_numpy()]
    order = np.lexsort((sorts, parent))
    twins = np.flatnonzero((parent[order[1:]] == parent[order[:-1]]) & (sorts[order[1:]] == sorts[order[:-1]]) & named[order[1:]])
    good[of[order[twins]]] = False  # an object that names a key twice is not read
    sibling = np.empty(len(node), np.int64)
    sibling[order] = np.arange(len(node)) - firsts[parent[order] + 1]

    kept = good[of]
    levels = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[levels], np.arange(int(depth.max()) + 2)) if len(depth) else np.zeros(1, np.int64)
    left_out = np.zeros(len(node), np.int64)
    cut = np.zeros(docs, bool)
    if max_entries is not None:
        left_out = np.maximum(children - max_entries, 0)
        kept &= (parent < 0) | (sibling < max_entries)
    if max_depth is not None:
        kept &= depth <= max_depth
    if max_entries is not None or max_depth is not None:
        for a, b in zip(edges[1:-1], edges[2:]):
            here = levels[a:b]
            kept[here] &= kept[parent[here]]
        deep = (depth == max_depth) & (children > 0) if max_depth is not None else np.zeros(len(node), bool)
        inside = depth < max_depth if max_depth is not None else np.ones(len(node), bool)
        cut[of[kept & (deep | (inside & (left_out > 0)))]] = True

    # Pre-order: what lies below a table stands between its brackets.
    ends = np.flatnonzero(closing)
    shut = node + 1
    shut[number[around[ends]]] = ends
    upto = np.searchsorted(node, shut)
    counted = np.concatenate(([0], np.cumsum(kept)))
    size = counted[upto] - counted[:-1]
    passed = np.cumsum(size[order]) - size[order]
    offset = np.empty(len(node), np.int64)
    offset[order] = passed - passed[np.minimum(firsts[parent[order] + 1], max(len(order) - 1, 0))] if len(order) else passed
    position = np.zeros(len(node), np.int64)
    for a, b in zip(edges[1:-1], edges[2:]):
        here = levels[a:b]
        position[here] = position[parent[here]] + 1 + offset[here]
    if max_nodes is not None:
        cut[of[kept & (position >= max_nodes)]] = True
        kept &= position < max_nodes

    shown = np.flatnonzero(kept)
    shown = shown[np.lexsort((position[shown], of[shown]))]
    places = np.full(len(node) + 1, -1)
    places[shown] = np.arange(len(shown))
    keys = pc.replace_with_mask(pa.nulls(len(node), pa.large_string()), pa.array(named), names)
    keys = pc.if_else(pa.array(listed), pa.array(entry + 1).cast(pa.large_string()), keys)
    scalar = kind[node]
    raw, kinds = _scalars(data, scalar, start[node], end[node])
    take = pa.array(shown)
    return Nodes(
        of[shown], position[shown], depth[shown], places[parent[shown]], keys.take(take), listed[shown],
        kinds.take(take), raw.take(take), left_out[shown], cut,
    )


def _scalars(data: np.ndarray, token: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The raw value and the kind of each node."""
    strings, bare = token == STRING, token == SCALAR
    texts = _texts(data, start[bare], end[bare])
    raw = pa.nulls(len(token), pa.large_string())
    raw = pc.replace_with_mask(raw, pa.array(strings), _unquoted(_texts(data, start[strings], end[strings])))
    of_bare = pc.if_else(pc.is_in(texts, pa.array(["true", "false"], pa.large_string())), "boolean", pc.if_else(pc.equal(texts, "null"), "nil", "number"))
    raw = pc.replace_with_mask(raw, pa.array(bare), pc.if_else(pc.equal(texts, "null"), pa.scalar(None, pa.large_string()), texts))
    kinds = pc.if_else(pa.array(strings), "string", "table").cast(pa.string())
    return raw.cast(pa.string()), pc.replace_with_mask(kinds, pa.array(bare), of_bare.cast(pa.string()))


def climbed(nodes: Nodes, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): for each node the ``steps`` nodes from ``start`` upwards, in that order."""
    offsets = np.concatenate(([0], np.cumsum(steps)))
    places = np.empty(offsets[-1], np.int64)
    active, at = np.flatnonzero(steps > 0), start
    now, done = at[active], 0
    while len(active):
        places[offsets[active] + done] = now
        done += 1
        more = steps[active] > done
        active, now = active[more], nodes.parent[now[more]]
    return offsets, places


def paths(nodes: Nodes) -> pa.Array:
    """Keys from the root down to each node."""
    offsets, places = climbed(nodes, nodes.depth, np.arange(len(nodes.depth)))
    # Each path was climbed from below: turn it round.
    turned = np.repeat(offsets[1:] + offsets[:-1] - 1, nodes.depth) - np.arange(len(places))
    return pa.LargeListArray.from_arrays(pa.array(offsets), nodes.key.take(pa.array(places[turned])).cast(pa.string())).cast(pa.list_(pa.string()))


def endings(nodes: Nodes) -> pa.Array:
    """For each node, the entries left out of the tables that end after it, the innermost first."""
    n = len(nodes.depth)
    following = np.zeros(n, np.int64)
    following[:-1] = np.where(nodes.doc[1:] == nodes.doc[:-1], nodes.depth[1:], 0) if n else 0
    offsets, places = climbed(nodes, np.maximum(nodes.depth - following, 0), nodes.parent)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes.left_out[places], pa.int32()))
