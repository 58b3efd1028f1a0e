"""Pieces that go through the transducer together get the ids that each gets alone."""

import random

import numpy as np
import pytest

from fieldscope.llm import bpe, queries, segments


def _pieces(rng, n):
    parts = ["an", "er", "th", "on", "é", "st", "ou", "le", "漢", "🙂", "#", "&", " ", "x" * 9]
    return list({"".join(rng.choice(parts) for _ in range(rng.randint(1, 30))).encode() for _ in range(n)})


@pytest.mark.parametrize("kept, lanes", [(500_000, 8192), (300, 7)])
def test_many_pieces_as_alone(monkeypatch, kept, lanes):
    monkeypatch.setattr(bpe, "KEPT_STEPS", kept)
    monkeypatch.setattr(bpe, "LANES", lanes)
    ranks = bpe.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken"))
    pieces = [b"", b"a", b"y" * 700, *_pieces(random.Random(3), 400)]
    alone = bpe.Transducer(ranks)
    together = bpe.Transducer(ranks)
    for _ in range(2):  # the second time by kept steps
        found = [np.frombuffer(x, "<u4").tolist() for x in together.many(pieces)]
        assert found == [alone.ids(p) for p in pieces]
    assert together.many([]) == []


def test_texts_of_a_batch_as_alone(monkeypatch):
    monkeypatch.setattr(segments, "KEPT", 50)
    rng = random.Random(5)
    words = [p.decode() for p in _pieces(rng, 200)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "&&&", "\n"]) for _ in range(40)) for _ in range(30)]
    texts += [None, "", " ", "a  b", "say  \n so ", texts[0]]
    make = lambda: bpe.Coder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_rule())
    coder, other = make(), make()
    assert [x for at in range(0, len(texts), 9) for x in coder.encode_all(texts[at : at + 9])] == [other.encode(t) for t in texts]


def test_new_words_take_their_steps_together(monkeypatch):
    coder = bpe.Coder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_rule())
    asked = []
    monkeypatch.setattr(coder.transducer, "ids", lambda piece, ids=coder.transducer.ids: asked.append(piece) or ids(piece))
    coder.encode_all([" ".join(f"ingtith{a}ndthha{b}" for a in "abcdefgh" for b in "abcdefgh")])
    assert [p for p in asked if p not in coder.transducer.ranks] == []
