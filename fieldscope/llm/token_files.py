"""Token ids in ORC files, and reads that take only what they need of them.

Method: ORC stripes whose integer columns are run-length encoded, with row indexes and Bloom filters on
the document id: readers work on stripes in parallel and skip those whose statistics or filters rule a
document out.
"""

from __future__ import annotations

import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm import arrays, segments
from fieldscope.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WRITTEN = "doc_id long, part int, at long, n int, ids array<int>"
# What the tokenizers library's byte-level pre-tokenizer splits by: fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 400_000  # pieces whose ids a worker keeps, some 100 MB
FILES = 100_000  # files whose starts may be broadcast: 12 bytes each
FEW = 1024  # rows handed on at once


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Whole:
    """A tokenizer of any kind, text by text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.encode(t) + end for t in texts]
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)


class _Words(segments.Segments):
    """Segments whose words are looked up once per call, however often they occur."""

    def __init__(self, tokenize, kept: int):
        letters = byte_letters()
        numbers = lambda piece: [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]
        super().__init__(segments.split_pattern(BYTE_LEVEL), numbers, kept)
        self.tokenize, self.blank = tokenize, letters[0x20]

    def after_blank(self, rest: str) -> bytes:
        """Words of ASCII letters, also with a mark behind them, go to the model as they are."""
        if rest.isascii():
            if rest.isalpha():
                return np.array([t.id for t in self.tokenize(self.blank + rest)], "<u4").tobytes()
            word, mark = rest[:-1], rest[-1:]
            if mark in segments.MARKS and word.isalpha():
                return self.spaced[word] + self.pieces[mark]
        return super().after_blank(rest)

    def encode_all(self, texts: list[str], end: bytes, apart) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with ``end`` behind it, and how many each text has.

        ``apart`` gives the whole ids of a text that needs another way, else None.
        """
        self.pieces, self.spaced = self.pieces.renewed(), self.spaced.renewed()
        heads, rests = [], []
        for text in texts:
            own = apart(text)
            if own is None and not segments.UNSAFE.search(text):
                head, blank, rest = text.partition(" ")
                heads.append(self.whole(head))
                rests.append(rest if blank else None)
            else:
                heads.append(self.whole(text) if own is None else own)
                rests.append(None)
        words = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        counts = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = [*map(self.spaced.__getitem__, known), *heads, end]
        # Every text is its head, its other words and its end, by their places in ``held``.
        borders = np.concatenate(([0], np.cumsum(counts + 2)))
        order = np.full(borders[-1], len(held) - 1)
        order[borders[:-1]] = len(known) + np.arange(len(texts))
        inner = np.ones(borders[-1], bool)
        inner[borders[:-1]] = inner[borders[1:] - 1] = False
        order[inner] = coded.indices.to_numpy()
        taken = pa.array(held, pa.large_binary()).take(pa.array(order))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(order) + 1] // 4
        return np.frombuffer(data, "<u4")[: ends[-1]], np.diff(ends[borders])


class _Pieces(_Whole):
    """A plain byte-level tokenizer: its model is asked for each new piece; texts with an added token in them go to it whole."""

    def __init__(self, tokenizer, added: list[str]):
        super().__init__(tokenizer)
        self.words = _Words(tokenizer.model.tokenize, KEPT)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def encode_all(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.words.encode_all(texts, end, lambda text: self.encode(text) if self.added and self.added.search(text) else None)


def coder_of(tokenizer_file: str, special_as_text: bool = False):
    """Encodes texts as the tokenizers library does."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = special_as_text
    parts = json.loads(tokenizer.to_str())
    splits = parts["pre_tokenizer"] or {}
    plain = splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
    if not plain or parts["normalizer"] or parts["post_processor"] or parts["truncation"] or parts["padding"]:
        return _Whole(tokenizer)
    return _Pieces(tokenizer, [t["content"] for t in parts["added_tokens"] if t["content"] and not (special_as_text and t["special"])])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", stride: int = 1000, special_as_text: bool = False) -> None:
    """Encode every text with a byte-level tokenizer file, append ``end_id``, and write ORC files at ``path``.

    Rows lie in ascending order of id (null ids last, equal ids by text) within and across files. Each row holds
    doc_id, part and at (the file's number, and where its ids start in it), n and ids. Strings of special
    tokens in a text become their ids, as an unmodified tokenizer has it, or are ordinary text with ``special_as_text``. Null text: the end id
    alone. Other columns are not read.
    """

    def encoded(batches):
        coder = arrays.worker_cache(f"tokenizer {special_as_text} {tokenizer_file}", lambda: coder_of(tokenizer_file, special_as_text))
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, len(batch), FEW):
                rows = batch.slice(low, FEW)
                ids, n = coder.encode_all([t or "" for t in rows["text"].to_pylist()], end)
                borders = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(np.full(len(n), part), pa.int32()), pa.array(at + borders[:-1], pa.int64()), pa.array(n, pa.int32()), lists],
                    ["doc_id", "part", "at", "n", "ids"],
                )
                at += int(borders[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    (
        rows.repartitionByRange(order, F.xxhash64("text"))
        .sortWithinPartitions(order, "text")
        .mapInArrow(encoded, WRITTEN)
        .write.option("compression", "none")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(WRITTEN).orc(path)


def token_starts(tokens: DataFrame) -> DataFrame:
    """``tokens`` with start: the number of ids of all rows before this one, over all files in order.

    Only part, at and n of each file are read for the totals; a row per file meets in one task, and goes to all tasks
    if there are no more than FILES of them.
    """
    ends = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("_held"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part", F.coalesce(F.sum("_held").over(order), F.lit(0)).alias("_before"))
    before = pin(before, "token-starts")
    if before.count() <= FILES:
        before = F.broadcast(before)
    return tokens.join(before, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def summed(batches):
        for batch in batches:
            ids = batch["ids"]
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
