"""Removal of byte strings that stand earlier in the corpus.

Method: the suffixes at candidate places are put in order by deep-shallow sorting (multikey quicksort to a shallow depth,
then blind tries for the groups that still agree), which brings equal strings of ``length`` bytes together.

Candidates: of the grams (half the length) in a string, the one of least hash is its anchor. Equal strings have equal
anchors, so a string whose anchor occurs once in the corpus is unique. Consecutive strings with one anchor form a run;
its bytes (about a length and a half) go to the bucket of the anchor only if the anchor occurs twice. Equal runs are
one class there; the suffixes of different classes with one anchor are sorted.

An anchor of more than HOT runs would not fit a bucket. Its runs are cut into their strings instead: a block judges its
own, and sends each that may stay to the bucket of the whole string, so that equal ones still meet.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fieldscope.llm import arrays, blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGNATURES = "bucket long, block long, hashes binary, sizes binary"
FLAGS = "block long, bucket long, bits binary, hot binary"
RUNS = "bucket long, block long, keys binary, text binary, lengths binary, repeats binary, row binary, start binary, ids binary, marks binary, done binary"
CUTS = "block long, cuts binary"
CLEANED = "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>"

SHALLOW = 16  # bytes ordered by quicksort
PIECE = 1 << 20  # bytes whose grams are hashed at once
HOT = 50_000  # runs of one anchor, of some 150 bytes each, that may go to one bucket


# --- deep-shallow sorting ---------------------------------------------------------------------------------------


def _characters(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big character."""
    out = np.zeros(len(places), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | text[places + i]
    return out


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of the strings, all of one length, in order and equal ones together.

    Inner nodes hold a depth and children by the byte at that depth; the bytes between are not looked at on the way
    down. The leaf that is reached tells by its common prefix where the string belongs.
    """
    size = len(strings[0])
    codes = [int.from_bytes(s, "big") for s in strings]
    root = [size, [0]]  # [depth, children by byte]; a leaf has the full depth and the numbers of its strings
    for number in range(1, len(strings)):
        string, node = strings[number], root
        while node[0] < size:
            children = node[1]
            node = children.get(string[node[0]]) or next(iter(children.values()))
        apart = codes[number] ^ codes[node[1][0]]
        if not apart:
            node[1].append(number)
            continue
        shared = size - (apart.bit_length() + 7) // 8
        other = strings[node[1][0]]
        node = root
        while node[0] < shared:
            node = node[1][string[node[0]]]
        leaf = [size, [number]]
        if node[0] == shared:
            node[1][string[shared]] = leaf
        else:
            below = [node[0], node[1]]
            node[0], node[1] = shared, {string[shared]: leaf, other[shared]: below}
    out, stack = [], [root]
    while stack:
        depth, held = stack.pop()
        if depth == size:
            out.append(held)
        else:
            stack.extend(held[b] for b in sorted(held, reverse=True))
    return out


def deep_shallow(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``length`` bytes at the places, and for each sorted one whether it equals the one before."""
    depth = min(SHALLOW, length // 8 * 8)
    order = np.arange(len(places))
    group = np.zeros(len(places), np.int64)  # of each sorted place: what agrees so far
    for at in range(0, depth, 8):
        key = _characters(text, places[order] + at)
        step = np.lexsort((key, group))
        order, key, group = order[step], key[step], group[step]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
    equal = np.zeros(len(order), bool)
    if depth == length:
        equal[1:] = group[1:] == group[:-1]
        return order, equal
    raw = text.tobytes()
    borders = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(order)) if len(order) else np.zeros(1, int)
    for i in np.flatnonzero(np.diff(borders) > 1).tolist():
        a, b = int(borders[i]), int(borders[i + 1])
        members = order[a:b]
        groups = blind_trie([raw[p + depth : p + length] for p in places[members].tolist()])
        order[a:b] = members[[n for g in groups for n in g]]
        at = a
        for g in groups:
            equal[at + 1 : at + len(g)] = True
            at += len(g)
    return order, equal


# --- runs of strings with one anchor ----------------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def _runs(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First string, end of strings, anchor of each run, and whether the anchor occurs twice in it; ``borders`` begin documents."""
    gram = length // 2
    width, n = length - gram + 1, len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = arrays.gram_hashes(data, gram)
    least = _least(grams, width)
    inner = borders[(borders > 0) & (borders < len(data))]
    valid = ~arrays.covered(np.maximum(inner - length + 1, 0).clip(max=n), inner.clip(max=n), n)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    stops = np.append(np.flatnonzero(new | ~valid), n)
    end = stops[np.searchsorted(stops, start, side="right")]
    # anchors: grams that are the least of some string. One that comes again as soon as the run allows tells of a period.
    padded = np.concatenate((np.full(width - 1, 0, np.uint64), least, np.full(width - 1, 0, np.uint64)))
    highest = ~_least(~padded, width)
    anchors = np.flatnonzero(highest[: len(grams)] == grams)
    again = (grams[anchors[1:]] == grams[anchors[:-1]]) & (np.diff(anchors) <= width)
    at = anchors[:-1][again]
    at = at[(at < n)]
    at = at[valid[at] & (least[at] == grams[at])]
    periodic = np.zeros(len(start), bool)
    periodic[np.searchsorted(start, at, side="right") - 1] = True
    return start, end, least[start], periodic


def _block_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of all documents of a block; a document longer than a piece is taken piece by piece."""
    found = []
    for a, b in arrays.doc_slices(offsets, PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        for at in range(low, max(low + 1, high - length + 1), PIECE if b == a + 1 else max(1, high - low)):
            stop = min(high, at + PIECE + length - 1) if b == a + 1 else high
            start, end, key, periodic = _runs(data[at:stop], offsets[a : b + 1] - at, length)
            found.append((start + at, end + at, key, periodic))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _first_rows(rows: pa.Table, ids: np.ndarray) -> np.ndarray:
    """Of each ordered row the first one with equal id and text."""
    texts = rows["text"].to_pylist()
    first = np.arange(len(ids))
    for i in range(1, len(ids)):
        if ids[i] == ids[i - 1] and texts[i] == texts[i - 1]:
            first[i] = first[i - 1]
    return first


def _bytes(rows: pa.Table, ids: np.ndarray):
    """The block's bytes, each repeated row but the first emptied."""
    first = _first_rows(rows, ids)
    if (first != np.arange(len(ids))).any():
        texts = [t if f == i else "" for i, (t, f) in enumerate(zip(rows["text"].to_pylist(), first))]
        return *arrays.text_bytes(pa.array(texts, pa.string())), first
    return *arrays.text_bytes(rows["text"]), first


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (arrays.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def _kept(group: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which occurrences stay: of each group those of the least id, and in each such row the first place."""
    order = np.lexsort((start, marks, ids, group))
    g, d, m = group[order], ids[order], marks[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    fresh = new.copy()
    fresh[1:] |= (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    kept = np.empty(len(g), bool)
    kept[order] = (d == d[head]) & fresh
    return kept


def _strings(raw: bytes, start: np.ndarray, end: np.ndarray, of: np.ndarray, ids: np.ndarray, length: int):
    """The strings of the runs, begin and document of each, that may stay by the block alone: those of the least id, the first of
    each document. The others, as (begin, document), stand earlier in the block. Runs are in order of documents."""
    begin, owners, lost, seen, least = [], [], [], set(), {}
    for first, stop, doc in sorted(zip(start.tolist(), end.tolist(), of.tolist())):
        for a in range(first, stop):
            string = raw[a : a + length]
            if ids[least.setdefault(string, doc)] != ids[doc] or (string, doc) in seen:
                lost.append((a, doc))
            else:
                seen.add((string, doc))
                begin.append(a)
                owners.append(doc)
    return np.array(begin, np.int64), np.array(owners, np.int64), lost


def substring_dedup(
    docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """Each document's bytes without those covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or an earlier place in the same row. Strings never cross documents and are judged on
    the input. Returns a row per input row: doc_id, n_bytes, kept (the remaining bytes), removed (maximal byte intervals, end exclusive).

    Null or empty text: no bytes. Null id: counts as larger than all others. Different rows of equal id do not remove
    from each other; a repeated row gets the same answer each time. An empty table gives an empty result; other
    columns are not read. ``length`` is at least 16.
    """
    if length < 16:
        raise ValueError("length is at least 16 bytes")
    volume = blocks.text_volume(docs, text)
    texts = blocks.in_blocks(docs, blocks.shares(volume, block_bytes), doc_id, text)
    buckets = blocks.shares(volume, bucket_bytes)

    def signatures(table: pa.Table) -> pa.Table:
        rows, ids = blocks.ordered(table)
        data, offsets, _ = _bytes(rows, ids)
        keys, times = np.unique(_block_runs(data, offsets, length)[2], return_counts=True)
        sizes = np.ceil(np.log2(times)).astype(np.uint8)
        gather, names, borders = blocks.by_bucket(_bucket_of(keys, buckets))
        return pa.table(
            {
                "bucket": pa.array(names, pa.int64()),
                "block": pa.array([table["block"][0].as_py()] * len(names), pa.int64()),
                "hashes": pa.array(blocks.packed(keys[gather], borders), pa.binary()),
                "sizes": pa.array(blocks.packed(sizes[gather], borders), pa.binary()),
            }
        )

    def counted(table: pa.Table) -> pa.Table:
        keys, sizes = blocks.joined(table["hashes"], np.uint64)
        runs = np.left_shift(1, blocks.joined(table["sizes"], np.uint8)[0].astype(np.int64))
        order, begins, run = blocks.firsts(keys)
        twice, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)
        twice[order] = (np.diff(np.append(begins, len(keys))) > 1)[run]
        hot[order] = (np.add.reduceat(runs[order], begins) > HOT)[run] if len(keys) else False
        borders = np.concatenate(([0], np.cumsum(sizes)))
        bits, hots = ([np.packbits(x[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:])] for x in (twice, hot))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())})

    def candidates(table: pa.Table, flags: pa.Table) -> pa.Table:
        rows, ids = blocks.ordered(table)
        data, offsets, _ = _bytes(rows, ids)
        start, end, key, periodic = _block_runs(data, offsets, length)
        keys, place, times = np.unique(key, return_inverse=True, return_counts=True)
        gather, names, borders = blocks.by_bucket(_bucket_of(keys, buckets))
        bits = dict(zip(flags["bucket"].to_pylist(), zip(flags["bits"].to_pylist(), flags["hot"].to_pylist())))
        wanted, hot = times > 1, np.zeros(len(times), bool)
        for name, a, b in zip(names.tolist(), borders[:-1], borders[1:]):
            twice, many = (np.unpackbits(np.frombuffer(x, np.uint8), count=b - a).view(bool) for x in bits[name])
            wanted[gather[a:b]] |= twice
            hot[gather[a:b]] = many
        chosen = np.flatnonzero(wanted[place] | periodic)
        owner = np.searchsorted(offsets, start[chosen], side="right") - 1
        raw = data.tobytes()
        seen, sent, spans, done = {}, [], [], []
        for i, doc, a, b in zip(chosen.tolist(), owner.tolist(), start[chosen].tolist(), (end[chosen] + length - 1).tolist()):
            span = raw[a:b]
            before = seen.setdefault(span, doc)
            if len(seen) > len(spans) or (before != doc and ids[before] == ids[doc]):
                sent.append((i, doc))
                spans.append(span) if len(seen) > len(spans) else None
            else:  # all its strings start in an earlier document or place of this block
                done.append((doc, a - int(offsets[doc]), b - int(offsets[doc])))
        at, of = (np.array(x, np.int64) for x in zip(*sent)) if sent else (np.zeros(0, np.int64),) * 2
        marks = np.array([hash_text(t) for t in rows["text"].to_pylist()], np.uint64)
        cold = ~hot[place[at]]
        if not cold.all():
            begin, owners, lost = _strings(raw, start[at[~cold]], end[at[~cold]], of[~cold], ids, length)
            done += [(doc, a - int(offsets[doc]), a - int(offsets[doc]) + length) for a, doc in lost]
            whole = np.array([hash_bytes(raw[a : a + length]) for a in begin], np.uint64)
            start, end, key = np.append(start[at[cold]], begin).astype(np.int64), np.append(end[at[cold]], begin + 1).astype(np.int64), np.append(key[at[cold]], whole)
            periodic, of = np.append(periodic[at[cold]], np.zeros(len(begin), bool)), np.append(of[cold], owners).astype(np.int64)
            at = np.arange(len(of))
        gather, names, borders = blocks.by_bucket(_bucket_of(key[at], buckets))
        at, of = at[gather], of[gather]
        out = {c: [] for c in ("bucket", "block", "keys", "text", "lengths", "repeats", "row", "start", "ids", "marks", "done")}
        block = table["block"][0].as_py()

        def add(bucket, a, b, finished):
            held, local = np.unique(of[a:b], return_inverse=True)
            values = (
                bucket,
                block,
                key[at[a:b]].tobytes(),
                b"".join(raw[s:e] for s, e in zip(start[at[a:b]].tolist(), (end[at[a:b]] + length - 1).tolist())),
                (end[at[a:b]] - start[at[a:b]] + length - 1).astype(np.int32).tobytes(),
                periodic[at[a:b]].tobytes(),
                of[a:b].astype(np.int32).tobytes(),
                (start[at[a:b]] - offsets[of[a:b]]).tobytes(),
                ids[held][local].tobytes(),
                marks[held][local].tobytes(),
                finished,
            )
            for c, v in zip(out, values):
                out[c].append(v)

        for name, a, b in zip(names.tolist(), borders[:-1], borders[1:]):
            add(name, a, b, b"")
        if done:
            add(block % buckets, 0, 0, np.array(done, np.int64).tobytes())
        kinds = [pa.int64()] * 2 + [pa.binary()] * 9
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    def sorted_out(table: pa.Table) -> pa.Table:
        keys, sizes = blocks.joined(table["keys"], np.uint64)
        lengths, _ = blocks.joined(table["lengths"], np.int32)
        repeats, _ = blocks.joined(table["repeats"], np.bool_)
        row, _ = blocks.joined(table["row"], np.int32)
        start, _ = blocks.joined(table["start"], np.int64)
        ids, _ = blocks.joined(table["ids"], np.int64)
        marks, _ = blocks.joined(table["marks"], np.uint64)
        raw = b"".join(table["text"].to_pylist())
        begin = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        classes, name_of = {}, np.empty(len(keys), np.int64)
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            name_of[i] = classes.setdefault(raw[a:b], len(classes))
        stays = _kept(name_of, ids, marks, start)
        cut_at, cut_start, cut_end = [np.flatnonzero(~stays)], [np.zeros(int((~stays).sum()), np.int64)], [lengths[~stays].astype(np.int64)]

        # suffixes of runs whose anchor has another class, or recurs in the run
        rep = np.flatnonzero(stays)
        _, anchor, times = np.unique(keys[rep], return_inverse=True, return_counts=True)
        rep = rep[(times[anchor] > 1) | repeats[rep]]
        count = lengths[rep].astype(np.int64) - length + 1
        whose = np.repeat(np.arange(len(rep)), count)
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text = np.frombuffer(raw + bytes(8), np.uint8)
        order, equal = deep_shallow(text, begin[rep][whose] + shift, length)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(~equal)
        lost = ~_kept(group, ids[rep][whose], marks[rep][whose], start[rep][whose] + shift)
        first, last = arrays.runs(lost)
        for a, b in zip(first.tolist(), last.tolist()):  # a stretch of lost strings, cut where the run changes
            for at in range(int(whose[a]), int(whose[b - 1]) + 1):
                low, high = max(a, int(np.searchsorted(whose, at))), min(b, int(np.searchsorted(whose, at, side="right")))
                cut_at.append(rep[at : at + 1])
                cut_start.append(shift[low : low + 1])
                cut_end.append(shift[high - 1 : high] + length)
        at, a, b = np.concatenate(cut_at), np.concatenate(cut_start), np.concatenate(cut_end)
        cuts = np.stack((row[at].astype(np.int64), start[at] + a, start[at] + b), axis=1)
        source = np.repeat(np.arange(len(sizes)), sizes)[at]
        gather, names, borders = blocks.by_bucket(source)
        block_ids = table["block"].to_pylist()
        out_block = [block_ids[n] for n in names.tolist()]
        out = blocks.packed(cuts[gather], borders)
        for block, done in zip(block_ids, table["done"].to_pylist()):
            if done:
                out_block.append(block)
                out.append(done)
        return pa.table({"block": pa.array(out_block, pa.int64()), "cuts": pa.array(out, pa.binary())})

    def cleaned(table: pa.Table, cuts: pa.Table) -> pa.Table:
        rows, ids = blocks.ordered(table)
        first = _first_rows(rows, ids)
        spans = np.frombuffer(b"".join(cuts["cuts"].to_pylist()), np.int64).reshape(-1, 3)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        edges = np.searchsorted(spans[:, 0], np.arange(len(rows) + 1))
        kept, removed, sizes = [], [], []
        for i, text in enumerate(rows["text"].cast(pa.binary()).to_pylist()):
            text = text or b""
            own = spans[edges[first[i]] : edges[first[i] + 1]]
            if len(own):
                far = np.maximum.accumulate(own[:, 2])
                new = np.flatnonzero(np.concatenate(([True], own[1:, 1] > far[:-1])))
                begin, end = own[new, 1].tolist(), far[np.append(new[1:], len(own)) - 1].tolist()
            else:
                begin, end = [], []
            kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)])))
            removed.append([{"start": a, "end": b} for a, b in zip(begin, end)])
            sizes.append(len(text))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, kind)})

    flags = texts.groupBy("block").applyInArrow(signatures, SIGNATURES).groupBy("bucket").applyInArrow(counted, FLAGS)
    runs = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(candidates, RUNS)
    cuts = runs.groupBy("bucket").applyInArrow(sorted_out, CUTS)
    return texts.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(cleaned, CLEANED)


def hash_text(text: str | None) -> int:
    """Tells rows of one id apart."""
    import xxhash

    return xxhash.xxh64_intdigest((text or "").encode())


def hash_bytes(string: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(string)
