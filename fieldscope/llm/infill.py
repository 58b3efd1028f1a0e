"""Fill-in-middle examples from texts that are kept as seekable compressed frames.

Method: a text is stored as independent zstandard frames with the units (lines) and code points before each. Choosing
the places to cut decompresses the frames that hold them and no others; whole frames go into the output as they are, and
digests stream the output's frames in order.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME = 1 << 16  # bytes of text in a frame
LEVEL = 3  # of zstandard
ROWS = 256  # rows handed on at once
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
STORED = "doc_id long, n long, n_chars long, marked boolean, sizes array<int>, units array<long>, chars array<long>, payload binary"
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, sizes array<int>, payload binary"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
# The order of the three parts behind their marks, in the output of each form.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


def code_points(data: bytes) -> int:
    """Characters that start in these bytes of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def cut_frames(data: bytes, frame: int) -> list[bytes]:
    """``data`` in stretches of up to ``frame`` bytes that end between characters; nothing for no data."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + max(frame, 4))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


class Frames:
    """Independent frames that follow one another in ``payload``; the last few that were asked for stay decompressed."""

    def __init__(self, sizes, payload: bytes):
        self.ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
        self.payload = payload
        self.raw = lru_cache(maxsize=8)(self._raw)

    def __len__(self) -> int:
        return len(self.ends)

    def packed(self, f: int) -> bytes:
        return self.payload[self.ends[f - 1] if f else 0 : self.ends[f]]

    def _raw(self, f: int) -> bytes:
        return zstandard.decompress(self.packed(f))

    def lengths(self) -> list[int]:
        """Bytes of text in each frame, from the frames' heads."""
        return [zstandard.frame_content_size(self.packed(f)) for f in range(len(self))]

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The text's bytes from ``start`` to ``end``, frame by frame; frames outside stay packed."""
        at = 0
        for f, length in enumerate(self.lengths()):
            if at < end and at + length > start:
                yield self.raw(f)[max(0, start - at) : end - at]
            at += length

    def find(self, mark: bytes, start: int) -> int:
        """Where ``mark`` first stands at or after ``start``, across the borders of frames; -1 if nowhere."""
        at, carry = start, b""
        for piece in self.stream(start, sum(self.lengths())):
            held = carry + piece
            found = held.find(mark)
            if found >= 0:
                return at - len(carry) + found
            at += len(piece)
            carry = held[-(len(mark) - 1) :] if len(mark) > 1 else b""
        return -1


def unit_start(k: int, units: list[int], frames: Frames) -> tuple[int, int]:
    """(frame, offset) at which unit ``k`` starts; the end of the text if fewer units end before it. Reads one frame."""
    if k <= 0:
        return 0, 0
    f = int(np.searchsorted(units, k, side="left")) - 1  # the last frame with fewer than k line ends before it
    ends = np.flatnonzero(np.frombuffer(frames.raw(f), np.uint8) == 10)
    local = k - units[f] - 1
    return (f, int(ends[local]) + 1) if local < len(ends) else (f, len(frames.raw(f)))


def choice(doc_id: int | None, seed: int, n: int) -> tuple[int, int, int, int]:
    """Units before the two cuts, and the numbers that decide whether and how a text is transformed."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return first, second, h3 % 100, h4 % 100


def write_frames(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", frame: int = FRAME, marks: tuple[str, ...] = MARKS) -> None:
    """Store every text as frames at ``path`` (Parquet), a row per document.

    A row holds doc_id, n (units: a line with its end, or what follows the last one), n_chars, marked (one of ``marks``
    stands in the text), and per frame its packed size and the line ends and code points before it; ``payload`` is the
    frames one after the other, which any zstandard reader unpacks to the text. Null or empty text: no frames. Rows that repeat,
    equal and null ids are rows of their own. Other columns are not read, whatever their names.
    """
    found = [m.encode() for m in marks]

    def stored(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                rows = batch.slice(low, ROWS)
                data, offsets = arrays.text_bytes(rows["text"])
                out = []
                for i, a, b in zip(rows["doc_id"].to_pylist(), offsets[:-1], offsets[1:]):
                    whole = data[a:b].tobytes()
                    pieces = cut_frames(whole, frame)
                    packed = [pack(p) for p in pieces]
                    ends, chars = [0], [0]
                    for p in pieces:
                        ends.append(ends[-1] + p.count(b"\n"))
                        chars.append(chars[-1] + code_points(p))
                    n = ends[-1] + (whole[-1:] not in (b"", b"\n"))
                    out.append((i, n, chars[-1], any(m in whole for m in found), [len(p) for p in packed], ends[:-1], chars[:-1], b"".join(packed)))
                yield batch_of(out, STORED)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen.mapInArrow(stored, STORED).write.option("compression", "none").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(field.split(" ") for field in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def infill(frames: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each stored text as a fill-in-middle example: doc_id, n, form, prefix_chars, middle_chars, and the output as frames.

    Cuts stand between units, where the digest of ``seed:doc_id`` says (a null id counts as no digits). Form is plain for an
    empty text, for one that holds a mark, and for ``100 - rate`` of a hundred; else ``spm`` of a hundred are spm
    (suffix, prefix, middle) and the rest psm. Only frames that hold a cut are decompressed. The marks must be those that the
    frames were stored with; none of them may begin with the end of another.
    """
    tokens = [m.encode() for m in marks]

    def cut(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                out = []
                for row in batch.slice(low, ROWS).to_pylist():
                    frames = Frames(row["sizes"], row["payload"])
                    first, second, chance, kind = choice(row["doc_id"], seed, row["n"])
                    if not frames.ends or row["marked"] or chance >= rate:
                        out.append((row["doc_id"], row["n"], "plain", None, None, row["sizes"], row["payload"]))
                        continue
                    a, b = (unit_start(k, row["units"], frames) for k in (first, second))
                    form = "spm" if kind < spm else "psm"
                    end = len(frames) - 1, None
                    parts = [piece(frames, (0, 0), a, pack), piece(frames, b, end, pack), piece(frames, a, b, pack)]
                    made = [x for p in ORDERS[form] for x in (pack(tokens[p]), *parts[p])]
                    before = [row["chars"][f] + code_points(frames.raw(f)[:at]) for f, at in (a, b)]
                    out.append((row["doc_id"], row["n"], form, before[0], before[1] - before[0], [len(x) for x in made], b"".join(made)))
                yield batch_of(out, CUT)

    return frames.mapInArrow(cut, CUT)


def piece(frames: Frames, start: tuple[int, int], end: tuple[int, int | None], pack) -> Iterator[bytes]:
    """Packed frames of the text between two places: whole frames as they are stored, the rest of a cut frame packed anew."""
    for f in range(start[0], end[0] + 1):
        low, high = start[1] if f == start[0] else 0, end[1] if f == end[0] else None
        if low == 0 and high is None:
            yield frames.packed(f)
        elif part := frames.raw(f)[low:high]:
            yield pack(part)


def restored(frames: Frames, form: str, marks: list[bytes]) -> Iterator[bytes]:
    """The text that an output was made of, from the output and its form: parts between the marks, streamed in the text's order."""
    total = sum(frames.lengths())
    if form == "plain":
        yield from frames.stream(0, total)
        return
    spans, start = {}, 0
    for p, after in zip(ORDERS[form], (*ORDERS[form][1:], None)):
        start += len(marks[p])
        end = total if after is None else frames.find(marks[after], start)
        spans[p] = (start, end)
        start = end
    for p in (0, 2, 1):  # prefix, middle, suffix
        yield from frames.stream(*spans[p])


def digests(outputs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """SHA-256 of each output, and of the text rebuilt from it; frames are streamed, no text is put together."""
    tokens = [m.encode() for m in marks]

    def summed(batches):
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                out = []
                for row in batch.slice(low, ROWS).to_pylist():
                    frames = Frames(row["sizes"], row["payload"])
                    whole, again = hashlib.sha256(), hashlib.sha256()
                    for f in range(len(frames)):
                        whole.update(frames.raw(f))
                    for part in restored(frames, row["form"], tokens):
                        again.update(part)
                    out.append((row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], whole.hexdigest(), again.hexdigest()))
                yield batch_of(out, DIGESTS)

    return outputs.mapInArrow(summed, DIGESTS)


def texts(outputs: DataFrame) -> DataFrame:
    """The outputs as text: doc_id, form, text."""

    def unpacked(batches):
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                out = []
                for row in batch.slice(low, ROWS).to_pylist():
                    frames = Frames(row["sizes"], row["payload"])
                    out.append((row["doc_id"], row["form"], b"".join(frames._raw(f) for f in range(len(frames))).decode()))
                yield batch_of(out, "doc_id long, form string, text string")

    return outputs.mapInArrow(unpacked, "doc_id long, form string, text string")
