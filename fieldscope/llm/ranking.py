"""Ranked lexical search over a length-stratified index.

Method: documents of equal length normaliser m are a stratum, and postings lie by term and, within it, by tf. Impact depends
on tf and m alone, so a stratum works it out once per tf; with the largest tf of each of an item's terms it gives a bound
for the whole stratum. Strata of the highest bounds are visited first; of the others, those whose bound reaches the score
of the last document wanted. Hot strata are cut into pieces by rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import arrays, blocks, sharding
from fieldscope.plans.topk import top_per_key
from fieldscope.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 4 << 20  # bytes of text in a piece of a stratum
HOT = 1 << 20  # strata of more than a piece that may be broadcast: 12 bytes each
ITEMS = 4 << 20  # bytes of items that are searched at once
PAIRS = 1 << 20  # pieces to visit that may be broadcast with their items: 8 bytes an item
TILE = 1 << 20  # impacts that are held at once
GROUP = 16 << 20  # bytes of a Parquet row group
SEGMENT = """m long, piece int, ids array<long>, terms array<string>, df array<int>, top_tf array<int>,
    term_runs array<int>, run_tf array<int>, run_n array<int>, posts array<int>"""
FOUND = "item int, doc_id long, score long"
# Bytes of terms, [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+: digits, letters, and every byte of characters beyond ASCII.
TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to terms, where terms start, and the number of the first term of each document (n + 1 values)."""
    inside = TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    return inside, starts, np.searchsorted(starts, offsets)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, A-Z lower-cased, and the number of the first one of each document."""
    inside, starts, first = term_runs(data, offsets)
    kept = LOWER[data[inside]]
    borders = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(borders), pa.py_buffer(kept)), first


def term_numbers(texts: pa.Array) -> pa.Array:
    """The number of terms of each text; null has none."""
    data, offsets = arrays.text_bytes(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in arrays.doc_slices(offsets):
        out[a:b] = np.diff(term_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2])
    return pa.array(out, pa.int64())


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def segment(table: pa.Table) -> pa.Table:
    """The index of one piece of a stratum."""
    table = table.sort_by([("doc_id", "ascending")])
    data, offsets = arrays.text_bytes(table["text"])
    found, first = terms_of(data, offsets)
    coded = found.dictionary_encode()
    size, n = len(coded.dictionary), len(table)
    places = np.repeat(np.arange(n), np.diff(first)) * size + coded.indices.to_numpy()
    pairs, tf = np.unique(places, return_counts=True)
    doc, term = pairs // size, pairs % size
    order = np.lexsort((doc, -tf, term))
    doc, term, tf = doc[order], term[order], tf[order]
    new_term, new_tf = np.ones(len(term), bool), np.ones(len(term), bool)
    new_term[1:], new_tf[1:] = term[1:] != term[:-1], tf[1:] != tf[:-1]
    run = np.flatnonzero(new_term | new_tf)
    columns = [
        [table["m"][0].as_py()],
        [table["piece"][0].as_py()],
        [table["doc_id"].combine_chunks()],
        [coded.dictionary.cast(pa.string())],
        [np.bincount(term, minlength=size)],
        [tf[new_term]],
        [np.bincount(term[run], minlength=size)],
        [tf[run]],
        [np.diff(np.append(run, len(doc)))],
        [doc],
    ]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())] + [pa.list_(pa.int32())] * 6
    names = [f.split(" ")[0] for f in SEGMENT.replace("\n", "").replace("    ", " ").split(", ")]
    return pa.table([pa.array(c if isinstance(c[0], int) else [c[0].tolist() if isinstance(c[0], np.ndarray) else c[0].to_pylist()], k) for c, k in zip(columns, kinds)], names)


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Index every document at ``path``: ``index``, a row per piece of a stratum, and ``lengths``, documents by number of terms.

    Terms are maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Null, empty and blank texts
    have none: they are of length 0, and nothing finds them. Rows that repeat, equal and null ids are documents of their own.
    Other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = sharding.read_again_alike(chosen).withColumn("n", F.arrow_udf(term_numbers, "long")("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    chosen.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("bytes")).write.parquet(f"{path}/lengths")
    lengths = read_lengths(docs.sparkSession, path)
    total, terms = totals(lengths)
    m = F.expr(f"100 - 90 + (90 * n * {total}L) div {max(terms, 1)}L").alias("m")
    volumes = lengths.select(m, "bytes").groupBy("m").agg(F.sum("bytes").alias("bytes"))
    # No more than the whole text has pieces.
    hot = pin(volumes.where(F.col("bytes") > PIECE).select("m", F.ceil(F.col("bytes") / F.lit(PIECE)).alias("pieces")), "ranking")
    if hot.count() <= HOT:
        hot = F.broadcast(hot)
    dealt = chosen.select("doc_id", "text", m, F.monotonically_increasing_id().alias("at")).join(hot, "m", "left")
    # Equal rows are dealt too: their place in the input is part of the hash.
    piece = F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")
    held = dealt.select("m", piece, "doc_id", "text").groupBy("m", "piece").applyInArrow(segment, SEGMENT)
    held.write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(f"{path}/index")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, docs long, bytes long").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(f"{path}/index")


def totals(lengths: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    row = lengths.where("n > 0").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("n")).alias("l")).first()
    return int(row["n"] or 0), int(row["l"] or 0)


class Asked:
    """A bounded set of items: their different terms, and for each item the numbers and weights of its own."""

    def __init__(self, texts: list[str | None]):
        data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
        found, first = terms_of(data, offsets)
        coded = found.dictionary_encode()
        self.terms, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        own = [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:])]
        self.borders = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], total: int) -> None:
        for t in range(len(self.terms)):
            self.weights[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(t, 0) + 1)))

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The number of each of a piece's terms, -1 for those that no item asks for."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy()

    def bounds(self, numbers: np.ndarray, top_tf: np.ndarray, m: int) -> np.ndarray:
        """For each item, a score that no document of the piece exceeds."""
        best = np.zeros(len(self.terms), np.int64)
        held = numbers >= 0
        best[numbers[held]] = impacts(top_tf[held], m)
        sums = np.concatenate(([0], np.cumsum((best * self.weights)[self.flat])))
        return sums[self.borders[1:]] - sums[self.borders[:-1]]

    def of(self, item: int) -> np.ndarray:
        return self.flat[self.borders[item] : self.borders[item + 1]]


def lists(batch: pa.RecordBatch, name: str) -> list[pa.Array]:
    column = batch[name]
    return [column.values.slice(a, b - a) for a, b in zip(column.offsets.to_pylist()[:-1], column.offsets.to_pylist()[1:])]


def document_counts(index: DataFrame, asked: Asked) -> dict[int, int]:
    """Documents that hold each of the asked terms; tasks add up first."""

    def added(batches):
        held = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for terms, df in zip(lists(batch, "terms"), lists(batch, "df")):
                numbers = asked.numbers(terms)
                held[numbers[numbers >= 0]] += df.to_numpy()[numbers >= 0]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["term", "df"])

    sums = index.select("terms", "df").mapInArrow(added, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in sums.collect()}  # no more than the items' terms


def stratum_bounds(index: DataFrame, asked: Asked) -> DataFrame:
    """(item, m, piece, bound) for every piece that holds a term of the item; postings are not read."""

    def bounded(batches):
        for batch in batches:
            for m, piece, terms, top in zip(batch["m"].to_pylist(), batch["piece"].to_pylist(), lists(batch, "terms"), lists(batch, "top_tf")):
                bound = asked.bounds(asked.numbers(terms), top.to_numpy(), m)
                some = np.flatnonzero(bound)
                columns = [pa.array(some, pa.int32()), pa.array(np.full(len(some), m), pa.int64()), pa.array(np.full(len(some), piece), pa.int32()), pa.array(bound[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "m", "piece", "bound"])

    return index.select("m", "piece", "terms", "top_tf").mapInArrow(bounded, "item int, m long, piece int, bound long")


def best_of(scores: np.ndarray, k: int, least: int) -> np.ndarray:
    """Places of the k highest scores of at least ``least``; of equal ones the first."""
    some = np.flatnonzero(scores >= least)
    if len(some) > k:
        last = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= last]
    return some[np.argsort(-scores[some], kind="stable")][:k]


def scored(index: DataFrame, pairs: DataFrame, asked: Asked, k: int, least: dict[int, int]) -> DataFrame:
    """(item, doc_id, score) of the k best documents of each of ``pairs`` (item, m, piece) that reach the item's ``least``."""

    def visit(batches):
        for batch in batches:
            for low in range(len(batch)):
                row = batch.slice(low, 1)
                m, wanted = row["m"][0].as_py(), row["items"][0].as_py()
                numbers = asked.numbers(lists(row, "terms")[0])
                ids, posts = lists(row, "ids")[0], lists(row, "posts")[0].to_numpy()
                run_tf, run_n = lists(row, "run_tf")[0].to_numpy(), lists(row, "run_n")[0].to_numpy()
                tfs, which = np.unique(run_tf, return_inverse=True)
                run_impact = impacts(tfs, m)[which]  # once per tf of the stratum
                run_number = np.repeat(numbers, lists(row, "term_runs")[0].to_numpy())
                asks = np.repeat(run_number >= 0, run_n)
                number, impact, doc = np.repeat(run_number, run_n)[asks], np.repeat(run_impact, run_n)[asks], posts[asks]
                present = np.unique(number)
                place = np.full(len(asked.terms), -1)
                place[present] = np.arange(len(present))
                tile = max(1, TILE // max(1, len(present)))
                out = []
                for at in range(0, len(ids), tile):
                    here = slice(None) if len(ids) <= tile else (doc >= at) & (doc < at + tile)
                    held = np.zeros((len(present), min(tile, len(ids) - at)), np.int64)
                    held[place[number[here]], doc[here] - at] = impact[here]
                    for item in wanted:
                        own = asked.of(item)
                        own = own[place[own] >= 0]
                        scores = asked.weights[own] @ held[place[own]]
                        best = best_of(scores, k, max(1, least.get(item, 1)))
                        out.append((np.full(len(best), item), ids.take(pa.array(best + at)), scores[best]))
                columns = [pa.concat_arrays([pa.array(x, kind) for x in column]) for column, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    visits = pin(pairs.groupBy("m", "piece").agg(F.sort_array(F.collect_list("item")).alias("items")), "ranking")
    if visits.count() * max(1, len(asked.borders) - 1) <= PAIRS:
        visits = F.broadcast(visits)
    return index.join(visits, ["m", "piece"]).select("m", "items", "ids", "terms", "term_runs", "run_tf", "run_n", "posts").mapInArrow(visit, FOUND)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k highest-scoring documents of the index at ``path`` for each item: item_id, rank (from 1), doc_id, score.

    Scores are integers; only those above 0 count, equal ones go by ascending id (null ids last). Every document that holds a
    term of an item is in reach: a piece is left out only if its bound is below the score of the item's k-th
    document so far. Rows of items with the same id and text are one item; items without a term, or of a null text, find nothing. Items are taken
    in sets of some ITEMS bytes, dealt by hash, so that the set that is sent to all tasks is bounded.
    """
    index, (total, _) = read_index(spark, path), totals(read_lengths(spark, path))
    chosen = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    sets = blocks.shares(blocks.text_volume(chosen), ITEMS)
    done = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(sets):
        rows = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == number).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        found = search_set(index, Asked([r["text"] for r in rows]), total, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        done = done.union(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return done


def search_set(index: DataFrame, asked: Asked, total: int, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of a set of items, by number."""
    asked.weigh(document_counts(index, asked), total)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    bounds = pin(stratum_bounds(index, asked), "ranking")
    first = pin(top_per_key(bounds, ["item"], [F.col("bound").desc(), F.col("m"), F.col("piece")], k).drop("rank"), "ranking")
    begun = pin(top_per_key(scored(index, first, asked, k, {}), ["item"], order, k), "ranking")
    least = {r["item"]: r["score"] for r in begun.where(F.col("rank") == k).collect()}  # a number per item
    reached = index.sparkSession.createDataFrame([(i, s) for i, s in least.items()], "item int, least long")
    rest = bounds.join(first, ["item", "m", "piece"], "left_anti").join(F.broadcast(reached), "item", "left").where("bound >= coalesce(least, 1)")
    return top_per_key(begun.drop("rank").union(scored(index, rest, asked, k, least)), ["item"], order, k)
