"""Near-duplicate groups by SimHash fingerprints.

Method: pivot distance tables. Each different fingerprint's Hamming distances to a set of reference fingerprints are
worked out once; a pair whose distances to any reference differ by more than the radius cannot lie within it
(triangle inequality) and is discarded, survivors are verified. Pairs come from cells, so that not all are
looked at: fingerprints within the radius of 4 agree in at least two of six bit blocks.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm import arrays, blocks, components
from fieldscope.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 4
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, bits: six blocks
REFERENCES = [int(x) for x in arrays.mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))]
TILE = 2048  # fingerprints of a cell in one tile


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(data: bytes, words: int, xxh64) -> int:
    """64 bits of a text: a bit is 1 where it is set in over half of the shingles' hashes. No words: 0."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    hashes = [xxh64(joined[a:b], 42) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, fp) per row; row_key names the row by id and text. Null text counts as empty."""

    def hashed(batches):
        import xxhash

        for batch in batches:
            found = [_signed(fingerprint(t or b"", words, xxhash.xxh64_intdigest)) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(found, pa.int64())], ["doc_id", "row_key", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), blocks.row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(hashed, "doc_id long, row_key string, fp long")


def _distances():
    """Distances to the references, a byte each, eight to a long."""
    out = []
    for group in range(0, len(REFERENCES), 8):
        packed = F.lit(0).cast("long")
        for i, reference in enumerate(REFERENCES[group : group + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(reference)))).cast("long"), 8 * i))
        out.append(packed)
    return out


def _cells():
    """For each choice of two blocks: the choice and the bits of both."""
    out = []
    for number, chosen in enumerate(combinations(BLOCKS, 2)):
        key = F.lit(number).cast("long")
        for first, bits in chosen:
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        out.append(key)
    return F.array(*out)


def spanning(run_end: np.ndarray, share: np.ndarray, mixed: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """For each place the first place of its run that it is linked to by pairs within the radius, over any steps.

    Places of one run stand together. In a mixed run only pairs of different shares are looked at.
    """
    parent = np.arange(len(fp))
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < run_end[at]]
        if not len(at):
            return parent
        i = at[(parent[at] != parent[at + step]) & (~mixed[at] | (share[at] != share[at + step]))]
        for k in range(table.shape[1]):  # coordinate by coordinate: too far apart from a reference means too far apart
            i = i[np.abs(table[i, k] - table[i + step, k]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        for a in i.tolist():
            x, y = a, a + step
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        if len(i):
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
        step += 1


def links(different: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius of each other: no more per cell than it has members.

    ``different`` has one row per fingerprint ``fp``. A cell of over TILE members is split into shares, and each two
    shares meet in a tile of their own, so that no task holds more than two shares of a cell.
    """
    low, high = _distances()
    members = different.select("fp", low.alias("low"), high.alias("high"), F.explode(_cells()).alias("cell"))
    crowded = members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("shares"))
    dealt = members.join(crowded, "cell", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    tiles = dealt.select("cell", F.least("share", "other").alias("tile_a"), F.greatest("share", "other").alias("tile_b"), "share", "fp", "low", "high")
    key = ["cell", "tile_a", "tile_b"]

    def found(batches):
        names = [*key, "share", "fp", "low", "high"]
        rest = None
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
            if rest is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(rest, columns)]
            n = len(columns[0])
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            rest = [c[last:] for c in columns]  # the last tile may go on in the next batch
            yield edges([c[:last] for c in columns], new[:last])
        if rest is not None:
            new = np.zeros(len(rest[0]), bool)
            yield edges(rest, new)

    def edges(columns, new):
        n = len(new)
        borders = np.append(np.flatnonzero(new), n)
        run_end = borders[np.searchsorted(borders, np.arange(n), side="right")] if n else np.zeros(0, np.int64)
        _, tile_a, tile_b, share, fp, low, high = columns
        table = np.stack((low, high), axis=1).astype(np.int64).view(np.uint8).astype(np.int16) if n else np.zeros((0, 16), np.int16)
        codes = fp.astype(np.int64).view(np.uint64)
        parent = spanning(run_end, share, tile_a != tile_b, codes, table, radius)
        linked = np.flatnonzero(parent != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked], pa.int64()), pa.array(fp[parent[linked]], pa.int64())], ["a", "b"])

    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(found, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, row_key, fp, root (the component's smallest fingerprint as a signed number) and
    component_id, the smallest id that links of up to 4 differing bits lead to.

    Shingles of ``words`` words, ASCII letters lowered, repeats included; texts without words have fingerprint 0 and are linked
    like others. Null ids count as larger than all others (a component of nulls alone has a null id).
    Rows with equal fingerprints are one class from the start, however many they are; an empty table gives none.
    """
    marked = pin(fingerprints(docs, words, doc_id, text), "fingerprints")
    rows = marked.count()
    classes = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-classes", rows)
    roots = components.connected(links(classes.select("fp")), "fingerprint-links", rows).withColumnRenamed("node", "fp")
    component = roots.join(classes.drop("n"), "fp").groupBy("root").agg(F.min("least").alias("_least"))
    linked = components.salted_join(roots, component, "root", "fp")
    alone = F.col("root").isNull()
    named = classes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("_least")).alias("component_id")
    )
    return components.balanced_join(marked, named, "fp", "row_key", "n", rows)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id (then by row_key)."""
    groups = near_duplicates(docs, 4, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    key = blocks.spare("_row_key", docs.columns)
    chosen = groups.groupBy("root").agg(F.min_by("row_key", order).alias(key)).select(key)
    rows = docs.withColumn(key, blocks.row_key(doc_id, text))
    return rows.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)
