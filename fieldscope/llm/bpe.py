"""Byte-level BPE encoding and decoding.

Method: the merges are compiled into a lazily determinised finite-state transducer that emits tokens
after bounded lookahead; decoding streams through an incremental UTF-8 state machine.

Encoding rests on a property of rank merging: the encoding of every prefix of a piece ends with one
certain token, and a token may follow another exactly if the two, joined and encoded alone, come out as
those two. A state of the transducer is the set of positions (open ends) from which a token can still
grow, each with the token before it; an end is given up when no token starts with its bytes, so that lookahead never
exceeds the longest token. What all open ends agree on is emitted.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fieldscope.llm import arrays, segments

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT_STEPS = 500_000  # transitions and token pairs kept before they are worked out anew
LOOKAHEAD = 512  # bytes held back before what is certain is emitted; longer than any token
LANES, SHORT = 8192, 64  # pieces that go through the transducer together, and bytes of the longest of them

ENCODED = "doc_id long, ids binary, n_tokens long"
DECODED = "doc_id long, ids binary, n_tokens long, decoded binary, replaced long"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Moves:
    """Steps of the transducer in two arrays, looked up for many pieces at once: an open-addressed table of numbers above 0."""

    def __init__(self, most: int):
        bits = most.bit_length()
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.last, self.shift, self.held = (1 << bits) - 1, np.uint64(64 - bits), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where there is none."""
        at = self.slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], 0)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = at[left] + 1 & self.last
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def put(self, keys: np.ndarray, values: list[int]) -> None:
        """Adds keys that differ and are not in the table yet."""
        for key, at, value in zip(keys.tolist(), self.slots(keys).tolist(), values, strict=True):
            while self.keys[at]:
                at = at + 1 & self.last
            self.keys[at], self.values[at] = key, value
        self.held += len(values)


class Transducer:
    """Encodes pieces by ranks, byte by byte.

    A state is a tuple of open ends in order of position, the newest last: each the trie node of the bytes since
    then and the last token before then, as one number. Steps are worked out when first needed and kept.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: dict[int, int] = {}  # node << 8 | byte -> node
        self.ending, self.depth = [-1], [0]  # of each node: the token that ends there, its number of bytes
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for rank, length in self.lengths.items():
            self.sizes[rank] = length
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.children.get(key)
                if node is None:
                    node = self.children[key] = len(self.ending)
                    self.ending.append(-1)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.ending[node] = rank
        self.edges: dict[int, tuple[list, list]] = {}
        self.fits: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, int] = {}  # state << 8 | byte -> next state << 24 | token that ends there + 1
        self.moves = Moves(KEPT_STEPS + LANES * SHORT)  # the same, of pieces that go together; number 0 is no state
        self.number(())
        self.start = self.number((0,))

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
        return known

    def merged(self, data: bytes, upto: int = 1) -> list[bytes]:
        """``data`` after joining the neighbours of lowest rank, the leftmost first, until none can be joined or ``upto`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > upto:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int) -> tuple[list, list]:
        """What stands at the token's left and at its right border while it is built: (rank, bytes), oldest first."""
        known = self.edges.get(token)
        if known is None:
            data = self.tokens[token]
            left, right = ([], [])
            if len(data) > 1:
                halves = self.merged(data, 2)
                left, right = self.edge(self.ranks[halves[0]])[0], self.edge(self.ranks[halves[-1]])[1]
            known = self.edges[token] = ([*left, (token, data)], [*right, (token, data)])
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether the two stay apart: at no time does a join over the border come before the next join on either side."""
        key = before << 32 | token
        fit = self.fits.get(key)
        if fit is None and before < 0:
            fit = self.fits[key] = self.merged(self.tokens[token]) == [self.tokens[token]]
        if fit is None:
            if len(self.fits) >= KEPT_STEPS:
                self.fits.clear()
            right, left = self.edge(before)[1], self.edge(token)[0]
            i, j, last, fit = 0, 0, len(self.ranks) << 8, True
            while True:
                next_right = right[i + 1][0] if i + 1 < len(right) else last
                next_left = left[j + 1][0] if j + 1 < len(left) else last
                over = self.ranks.get(right[i][1] + left[j][1], last)
                if over < next_right and over <= next_left and over < last:
                    fit = False
                    break
                if next_right == last and next_left == last:
                    break
                if next_right <= next_left:
                    i += 1
                else:
                    j += 1
            self.fits[key] = fit
        return fit

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """State after one more byte, and the token that ends there."""
        grown, by = [], -1
        children, ending, fits = self.children, self.ending, self.fits
        for end in self.states[state]:
            node = children.get(end >> 24 << 8 | byte)
            if node is None:
                continue
            last = end & 0xFFFFFF
            grown.append(node << 24 | last)
            if by < 0:
                token = ending[node]
                if token >= 0:
                    fit = fits.get(last - 1 << 32 | token)
                    if self.follows(last - 1, token) if fit is None else fit:
                        by = token
        grown.append(by + 1)
        return self.number(tuple(grown)), by

    def certain(self, state: int, trail: list[int]) -> int:
        """The last position that the ways to all open ends of ``state`` go through."""
        ends = {len(trail) - self.depth[end >> 24] for end in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.lengths[trail[far - 1]])
        return ends.pop()

    def way(self, trail: list[int], upto: int) -> list[int]:
        """The tokens that lead to a position: each place's last token tells where the one before it ends."""
        out = []
        while upto:
            out.append(trail[upto - 1])
            upto -= self.lengths[trail[upto - 1]]
        return out[::-1]

    def make_room(self) -> None:
        if len(self.steps) + self.moves.held >= KEPT_STEPS:
            self.restart()

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """``ids`` of each piece as little-endian 32-bit numbers. Short pieces take their steps together, byte by byte."""
        out = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if 0 < len(piece) <= SHORT and piece not in self.ranks:
                short.append(i)
            else:
                out[i] = np.array(self.ids(piece), "<u4").tobytes()
        short.sort(key=lambda i: len(pieces[i]), reverse=True)
        for at in range(0, len(short), LANES):
            some = short[at : at + LANES]
            for i, ids in zip(some, self._together([pieces[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """``many`` of LANES pieces at most, the longest first."""
        self.make_room()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        states = np.full(len(pieces), self.start, np.int64)
        trail = np.zeros((int(lengths[0]), len(pieces)), np.int32)  # the last token at each position
        for j in range(len(trail)):
            live = int(np.searchsorted(-lengths, -j))  # pieces of more than j bytes
            keys = states[:live] << 8 | data[begins[:live] + j]
            moves = self.moves.get(keys)
            unknown = np.flatnonzero(moves == 0)
            if len(unknown):
                new, which = np.unique(keys[unknown], return_inverse=True)
                found = [state << 24 | by + 1 for state, by in (self.step(key >> 8, key & 0xFF) for key in new.tolist())]
                self.moves.put(new, found)
                moves[unknown] = np.array(found, np.int64)[which]
            states[:live] = moves >> 24
            trail[j, :live] = (moves & 0xFFFFFF) - 1
        upto, lanes, rounds = lengths.copy(), np.arange(len(pieces)), []
        counts = np.zeros(len(pieces), np.int64)
        while len(lanes):  # the ways back, a token of each piece a round
            tokens = trail[upto[lanes] - 1, lanes]
            rounds.append((lanes, tokens))
            counts[lanes] += 1
            upto[lanes] -= self.sizes[tokens]
            lanes = lanes[upto[lanes] > 0]
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), "<u4")
        for back, (lanes, tokens) in enumerate(rounds, 1):
            ids[ends[lanes] - back] = tokens
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(((ends - counts) * 4).tolist(), (ends * 4).tolist())]

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        self.make_room()
        out: list[int] = []
        state, known = self.start, self.steps.get
        trail: list[int] = []  # the last token at each position after the emitted ones
        for byte in piece:
            key = state << 8 | byte
            move = known(key)
            if move is None:
                state, by = self.step(state, byte)
                move = self.steps[key] = state << 24 | by + 1
            state = move >> 24
            trail.append((move & 0xFFFFFF) - 1)
            if len(trail) > LOOKAHEAD:
                sure = self.certain(state, trail)
                out += self.way(trail, sure)
                del trail[:sure]
        return out + self.way(trail, len(trail))


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes in, characters out as soon as they are complete.

    The state is the unfinished character: its bytes so far, how many are missing, and the range that the next
    byte must fall into. A byte outside it ends the unfinished character as one U+FFFD; ``escaped``, as a lone surrogate
    for each of its bytes, from which the bytes can be had back (``bytes_of``).
    """

    def __init__(self, escaped: bool = False) -> None:
        self.escaped = escaped
        self.pending, self.missing, self.low, self.high, self.replaced = b"", 0, 0x80, 0xBF, 0

    def _lead(self, byte: int) -> bool:
        """Begin the character that ``byte`` leads; false if it stands alone or can't begin one."""
        if 0xC2 <= byte <= 0xDF:
            self.missing, self.low, self.high = 1, 0x80, 0xBF
        elif 0xE0 <= byte <= 0xEF:
            self.missing, self.low, self.high = 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.missing, self.low, self.high = 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        else:
            return False
        self.pending = bytes((byte,))
        return True

    def _next(self, byte: int) -> bool:
        if not self.low <= byte <= self.high:
            return False
        self.pending += bytes((byte,))
        self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
        return True

    def _broken(self) -> str:
        self.missing, self.replaced = 0, self.replaced + 1
        return self.pending.decode("utf-8", "surrogateescape") if self.escaped else "\ufffd"

    @staticmethod
    def bytes_of(text: str) -> bytes:
        return text.encode("utf-8", "surrogateescape")

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        while self.missing and at < len(data):  # finish what the last bytes began
            if self._next(data[at]):
                at += 1
                if not self.missing:
                    out.append(self.pending.decode("utf-8"))
            else:
                out.append(self._broken())
        end = len(data)
        if not self.missing:
            for back in range(1, min(3, len(data) - at) + 1):  # hold back a character that is not complete
                if data[-back] >= 0xC0:
                    if self._lead(data[-back]) and self.missing >= back and all(self._next(b) for b in data[len(data) - back + 1 :]):
                        end -= back
                    else:
                        self.missing = 0
                    break
        try:
            out.append(data[at:end].decode("utf-8"))
        except UnicodeDecodeError:
            text = data[at:end].decode("utf-8", "replace")
            self.replaced += text.count("\ufffd") - data[at:end].count(b"\xef\xbf\xbd")
            out.append(data[at:end].decode("utf-8", "surrogateescape") if self.escaped else text)
        return "".join(out)

    def finish(self) -> str:
        return self._broken() if self.missing else ""


class Coder:
    """Both directions of a rank file in one worker."""

    def __init__(self, rank_file: str, pattern: str):
        ranks = read_ranks(rank_file)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.transducer = Transducer(ranks)
        self.segments = segments.Segments(segments.split_pattern(pattern), lambda piece: self.transducer.ids(piece.encode()))

    def encode(self, text: str | None) -> bytes:
        return self.segments.encode(text) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; what is new in them is worked out together."""
        self.segments.renew()
        new = self.segments.new_pieces(texts)
        self.segments.ready = dict(zip(new, self.transducer.many([piece.encode() for piece in new]), strict=True))
        done = [self.segments.encode_next(t) if t else b"" for t in texts]
        self.segments.ready = {}
        return done

    def decode(self, ids: bytes | None, step: int = 8192) -> tuple[bytes, int]:
        """The bytes of the text that the stream decoder makes of the tokens, and how many places would read as U+FFFD."""
        numbers = np.frombuffer(ids or b"", "<u4")
        strange = numbers >= len(self.tokens)
        stream, out, unknown = Utf8Stream(escaped=True), [], int(strange.sum())
        if unknown:
            numbers = numbers[~strange]
        for at in range(0, len(numbers), step):
            chunk = b"".join(map(self.tokens.__getitem__, numbers[at : at + step].tolist()))
            out.append(stream.bytes_of(stream.feed(chunk)))
        out.append(stream.bytes_of(stream.finish()))
        return b"".join(out), stream.replaced + unknown


def _parts(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _coded(source: DataFrame, rank_file: str, pattern: str, read_text: bool, write_text: bool) -> DataFrame:
    """One pass over ``source``: texts to ids, or ids as given; and back to bytes if asked for."""
    schema = DECODED if write_text else ENCODED

    def coded(batches):
        coder = arrays.worker_cache(f"bpe {rank_file} {pattern}", lambda: Coder(rank_file, pattern))
        for part in _parts(batches):
            if read_text:
                ids = coder.encode_all(part["text"].to_pylist())
                columns = [part["doc_id"], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            else:
                ids = part["ids"].to_pylist()
                columns = [part["doc_id"], part["ids"], part["n_tokens"]]
            if write_text:
                back = [coder.decode(x) for x in ids]
                columns += [pa.array([b for b, _ in back], pa.binary()), pa.array([n for _, n in back], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return source.mapInArrow(coded, schema)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")


def encode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, ids (little-endian unsigned 32-bit integers), n_tokens.

    Each match of ``pattern`` is encoded by the ranks of ``rank_file`` (a path that every executor has), without
    special tokens. Null or empty text: no ids. Ids and repeated rows are taken as they come; other
    columns are not read.
    """
    return _coded(_texts(docs, doc_id, text), rank_file, pattern, True, False)


def decode(tokens: DataFrame, rank_file: str, pattern: str = "") -> DataFrame:
    """``encode``'s rows with the decoded bytes, and how many places were no UTF-8 and would read as U+FFFD.

    Ids without a token decode to nothing and count as replaced. Null ids: empty.
    """
    return _coded(tokens.select("doc_id", "ids", "n_tokens"), rank_file, pattern, False, True)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, by one worker that holds the tables once."""
    return _coded(_texts(docs, doc_id, text), rank_file, pattern, True, True)
