"""Removal of word windows that an earlier document holds too.

Method: Rabin-Karp hashes of every window of ``width`` words, counted in Spark; repeated windows merge
into maximal removal intervals.
"""

from __future__ import annotations

import sys
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fieldscope.llm import arrays, blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGNATURES = "bucket long, block long, hashes binary, docs binary, counts binary"
FLAGS = "block long, bucket long, bits binary"
CLEANED = "doc_id long, text string, n_words long, removed array<struct<start:long,end:long>>"


def _windows(texts: pa.Table, width: int, buckets: int):
    """The windows of a block in order of document and place: hash, bucket, first word and owner, besides the words."""
    data, offsets = arrays.text_bytes(texts["text"])
    starts, ends, first_word = arrays.word_spans(data, offsets)
    codes = arrays.word_hashes(data, starts, ends)
    at = arrays.window_starts(first_word, width)
    owner = np.searchsorted(first_word, at, side="right") - 1
    key = arrays.span_hashes(codes, at, at + width, 2)
    bucket = (arrays.span_hashes(codes, at, at + width, 3) % np.uint64(buckets)).astype(np.int64)
    return data, offsets, first_word, at, owner, key, bucket


def _distinct(key: np.ndarray, bucket: np.ndarray):
    """Each different window once, at its first place, gathered by bucket."""
    order, begins, run = blocks.firsts(key)
    first = order[begins]
    place = np.argsort(first, kind="stable")  # back to the order of documents
    gather, names, borders = blocks.by_bucket(bucket[first[place]])
    return order, run, first, place[gather], names, borders


def substring_dedup(
    docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 32 << 20
) -> DataFrame:
    """Each document without the words covered by a window that also starts in a document of smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns a row per input row: doc_id, text (kept words
    joined by a space), n_words, removed (maximal intervals of word numbers, end exclusive). Windows are
    judged on the input. A window is known by 64 hash bits and by its bucket, which comes from an
    independent hash; buckets hold a bounded number of windows, so false equality stays below 1e-6 per
    bucket at any size.

    Null or blank text: no words, empty text. Null id: counts as larger than all others. Rows with
    equal ids do not remove from each other; a repeated row gets the same answer each time. An empty
    table gives an empty result; other columns are not read.
    """
    volume = blocks.text_volume(docs, text)
    texts = blocks.in_blocks(docs, blocks.shares(volume, block_bytes), doc_id, text)
    buckets = blocks.shares(volume * 8 // 6, bucket_bytes)  # a window for about every six bytes

    def signatures(table: pa.Table) -> pa.Table:
        rows, ids = blocks.ordered(table)
        *_, owner, key, bucket = _windows(rows, width, buckets)
        _, _, first, chosen, names, borders = _distinct(key, bucket)
        places = first[chosen]
        docs_of, counts = [], []
        for a, b in zip(borders[:-1], borders[1:]):
            held, n = np.unique(owner[places[a:b]], return_counts=True)
            docs_of.append(ids[held].tobytes())
            counts.append(n.astype(np.int32).tobytes())
        block = table["block"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(names, pa.int64()),
                "block": pa.array([block] * len(names), pa.int64()),
                "hashes": pa.array(blocks.packed(key[places], borders), pa.binary()),
                "docs": pa.array(docs_of, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
            }
        )

    def judged(table: pa.Table) -> pa.Table:
        keys, sizes = blocks.joined(table["hashes"], np.uint64)
        held, _ = blocks.joined(table["docs"], np.int64)
        counts, _ = blocks.joined(table["counts"], np.int32)
        doc = np.repeat(held, counts)
        order, begins, run = blocks.firsts(keys)
        least = np.minimum.reduceat(doc[order], begins)
        later = np.empty(len(keys), bool)
        later[order] = least[run] < doc[order]
        borders = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table(
            {
                "block": table["block"],
                "bucket": table["bucket"],
                "bits": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:])], pa.binary()),
            }
        )

    def cleaned(table: pa.Table, flags: pa.Table) -> pa.Table:
        rows, ids = blocks.ordered(table)
        data, offsets, first_word, at, owner, key, bucket = _windows(rows, width, buckets)
        order, run, first, chosen, names, borders = _distinct(key, bucket)
        bits = dict(zip(flags["bucket"].to_pylist(), flags["bits"].to_pylist()))
        elsewhere = np.zeros(len(first), bool)
        for name, a, b in zip(names.tolist(), borders[:-1], borders[1:]):
            elsewhere[chosen[a:b]] = np.unpackbits(np.frombuffer(bits[name], np.uint8), count=b - a).view(bool)
        gone = np.zeros(len(key), bool)
        gone[order] = elsewhere[run] | (ids[owner[order]] > ids[owner[first[run]]])
        cut = arrays.covered(at[gone], at[gone] + width, int(first_word[-1]))
        raw = data.tobytes()
        kept, removed, counts = [], [], np.diff(first_word)
        for i in range(len(rows)):
            mask = cut[first_word[i] : first_word[i + 1]]
            words = raw[offsets[i] : offsets[i + 1]].split()
            begin, end = arrays.runs(mask)
            kept.append(b" ".join(compress(words, (~mask).tolist()) if len(begin) else words))
            removed.append([{"start": s, "end": e} for s, e in zip(begin.tolist(), end.tolist())])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
                "n_words": pa.array(counts, pa.int64()),
                "removed": pa.array(removed, spans),
            }
        )

    flags = texts.groupBy("block").applyInArrow(signatures, SIGNATURES).groupBy("bucket").applyInArrow(judged, FLAGS)
    return texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(cleaned, CLEANED)
