"""Token ids of whole texts through caches of segments and pieces.

A byte-level BPE tokenizer encodes each match of its split pattern (a piece) on its own, so ids of a
piece can be kept. Pieces never run from a non-space into a space; cutting a text before every
blank therefore leaves all pieces whole, but where a blank stands inside a longer run of white space
that is followed by more white space or by the end. Such texts are cut by the pattern itself.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = 120_000  # entries of a table before a new one begins: memory is bounded, results don't depend on it
PLAIN = "\u0250"  # letters below are letters in every version of Unicode
MARKS = frozenset(".,;:!?")
UNSAFE = re.compile(r"\s (?!\S)")
# The white space that the tokenizers' split patterns know, in place of Python's.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pattern(pattern: str):
    """The compiled split pattern with ``\\s`` and ``\\S`` meaning Unicode white space."""
    import regex

    inside = re.sub(r"\[\^\\s", lambda _: "[^" + WHITE, pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class _Kept(dict):
    """Results by key; ``older`` is the table before it, whose entries move up when they are asked for again."""

    def __init__(self, build, most, older=None):
        super().__init__()
        self.build, self.most, self.older = build, most, older or {}

    def __missing__(self, key):
        made = self.older.get(key)
        if made is None:
            made = self.build(key)
        self[key] = made
        return made

    def renewed(self):
        """This table, or a new one after it when it is full; what is older still goes."""
        return self if len(self) < self.most else _Kept(self.build, self.most, dict(self))


class Segments:
    """Encodes texts to little-endian 32-bit ids; ``ids_of`` gives the ids of one piece, ``kept`` is the size of a table."""

    def __init__(self, pattern, ids_of, kept=None):
        self.ready: dict[str, bytes] = {}  # pieces that are worked out already
        self.ids = lambda piece: self.ready.get(piece) or b"".join([n.to_bytes(4, "little") for n in ids_of(piece)])
        self.find = pattern.findall
        self.pieces = _Kept(self.ids, kept or KEPT)
        self.spaced = _Kept(self.after_blank, kept or KEPT)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def new_pieces(self, texts) -> list[str]:
        """The pieces of the words that no table has yet; without those of texts that the pattern cuts."""
        words, heads = set(), set()
        for text in texts:
            if text and not UNSAFE.search(text):
                head, *rest = text.split(" ")
                heads.add(head)
                words.update(rest)
        known, older, pieces = self.spaced, self.spaced.older, set()
        for head in heads:
            pieces.update(self.find(head))
        for word in words:
            if word not in known and word not in older:
                plain = word[:-1] if word[-1:] in MARKS else word
                if not (plain.isalpha() and (plain.isascii() or max(plain) < PLAIN)):
                    pieces.update(self.find(" " + word))
                elif plain is word or plain not in known and plain not in older:
                    pieces.add(" " + plain)
        return [p for p in pieces if p not in self.pieces and p not in self.pieces.older]

    def after_blank(self, rest: str) -> bytes:
        """A blank and what follows it; a plain word, and one with a mark after it, need no search."""
        if rest.isalpha() and (rest.isascii() or max(rest) < PLAIN):
            return self.ids(" " + rest)
        word, mark = rest[:-1], rest[-1:]
        if mark in MARKS and word.isalpha() and (word.isascii() or max(word) < PLAIN):
            return self.spaced[word] + self.pieces[mark]
        return self.whole(" " + rest)

    def renew(self) -> None:
        self.pieces, self.spaced = self.pieces.renewed(), self.spaced.renewed()

    def encode(self, text: str) -> bytes:
        self.renew()
        return self.encode_next(text)

    def encode_next(self, text: str) -> bytes:
        """``encode`` by the tables as they are: none begins."""
        if UNSAFE.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.spaced.__getitem__, rest))
