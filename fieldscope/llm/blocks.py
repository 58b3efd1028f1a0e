"""Documents dealt into blocks, and signatures judged in buckets.

A block is a few megabytes of whole documents, chosen by a hash of their content, so that a lost task
comes back with the same block. Each block sends its *distinct* signatures, packed, to buckets by
signature; a signature that a third of all documents hold thus reaches its bucket once per block.
Buckets answer with one bit per signature. Texts are shuffled once; Spark reuses that exchange for
every later step of the same plan.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NULL_ID = np.iinfo(np.int64).max  # a null id sorts after every other


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts plus a little for each row: one number, for the sizes of blocks and buckets."""
    row = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)).alias("n")).first()
    return int(row["n"] or 0)


def row_key(doc_id: str, text: str):
    """Names a row by its id and a hash of its text; rows that repeat share a key, a null id is left out."""
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.hex(F.xxhash64(F.col(text))))


def spare(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as a column has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shares(volume: int, size: int) -> int:
    return max(1, -(-volume // size))


def in_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text): rows with equal content share a block, whatever task reads them."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).alias("block"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's documents by id, then text (nulls last), and the ids as numbers."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].fill_null(NULL_ID).to_numpy().astype(np.int64)
    return table.combine_chunks(), ids


def firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, start of each run of equal keys in it, and the run of each sorted place.

    The sort is stable, so a run begins with the key's first place.
    """
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that gathers places by bucket, the buckets that occur, and the n + 1 borders between them."""
    order = np.argsort(buckets, kind="stable")
    names, begins = np.unique(buckets[order], return_index=True)
    return order, names, np.append(begins, len(buckets))


def packed(values: np.ndarray, borders: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]


def joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row holds."""
    rows = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // size for r in rows], np.int64)
