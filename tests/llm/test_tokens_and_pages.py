"""Token ids against the public libraries, archives against their pages, and the registered queries."""

import base64
import hashlib
import random

import brute
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fieldscope.llm import bpe, quality, queries, segments, token_files, warc

public = pytest.importorskip("public_tokenizers")
RANKS = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library(reference):
    transducer = bpe.Transducer(bpe.read_ranks(RANKS))
    coder = segments.Segments(segments.split_pattern(public.PATTERN), lambda piece: transducer.ids(piece.encode()))
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "a", "b", "'s", "'", "1", "é", "漢", " ", "\x1c", " ", ".", "##", "🙂", "\t", "aa", "zq", "’", "ab ", " \n", "\x85", "_", "the", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference.encode_ordinary(text), repr(text)


def test_long_piece_is_emitted_on_the_way(reference):
    transducer = bpe.Transducer(bpe.read_ranks(RANKS))
    rng = random.Random(4)
    for letters in ("ab", "x", "thequickbrown"):
        piece = "".join(rng.choice(letters) for _ in range(4000))
        assert transducer.ids(piece.encode()) == reference.encode_ordinary(piece)


def test_small_tables_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STEPS", 5)
    monkeypatch.setattr(segments, "KEPT", 2)
    transducer = bpe.Transducer(bpe.read_ranks(RANKS))
    coder = segments.Segments(segments.split_pattern(public.PATTERN), lambda piece: transducer.ids(piece.encode()))
    for text in ("one two three four five six seven eight", "antidisestablishmentarianism, naïvely. Gödel"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_encode_and_decode(docs, rows, reference):
    done = bpe.decode(bpe.encode(docs, RANKS, public.PATTERN), RANKS).collect()
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, bytes(r.decoded), r.replaced) for r in done]
    want = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d, ids, len(ids), (t or "").encode(), 0))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(map(repr, bpe.round_trip(docs, RANKS, public.PATTERN).collect())) == sorted(map(repr, done))


def test_decode_of_strange_ids(spark):
    ids = np.array([127, 10**6, 255], "<u4").tobytes()
    row = bpe.decode(spark.createDataFrame([(1, bytearray(ids), 3), (2, None, 0)], bpe.ENCODED), RANKS).orderBy("doc_id").collect()
    assert row[0].replaced > 0 and bytes(row[1].decoded) == b"" and row[1].replaced == 0


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_utf8_stream(step):
    rng = random.Random(step)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 0xC0, 0xFF]) for _ in range(rng.randint(0, 12)))
        stream = bpe.Utf8Stream()
        text = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.finish()
        assert text == data.decode("utf-8", "replace") and stream.replaced == text.count("�")
        exact = bpe.Utf8Stream(escaped=True)
        parts = [exact.feed(data[i : i + step]) for i in range(0, len(data), step)] + [exact.finish()]
        assert b"".join(map(exact.bytes_of, parts)) == data and exact.replaced == stream.replaced


def test_decoding_takes_its_bytes_from_the_stream():
    coder = bpe.Coder(RANKS, public.PATTERN)
    for data in ("é漢🙂 naïve".encode() * 5, b"\xe6\xbc", b"a\xf0\x9f\x99b\xff\xe9"):
        numbers = np.array([coder.tokens.index(bytes((b,))) for b in data], "<u4").tobytes()
        for step in (1, 2, 3, 5):  # chunks that cut characters
            back, replaced = coder.decode(numbers, step)
            assert back == data and replaced == data.decode("utf-8", "replace").count("\ufffd")


def test_token_files(spark, docs, rows, tmp_path):
    import tokenizers

    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, public.path("byte_bpe_50k.json"))
    held = token_files.read_tokens(spark, path)
    done = token_files.token_checksums(token_files.token_starts(held))
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    order = sorted(rows, key=lambda r: (brute.key(r[0]), r[1] is not None, r[1] or ""))
    at, want = 0, []
    for d, t in order:
        want.append((d, len(ids[t]), brute.crc(ids[t])))
        at += len(ids[t])
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in done.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    starts = sorted((r.start, r.n_tokens, brute.key(r.doc_id)) for r in done.collect())
    assert [s for s, _, _ in starts] == np.concatenate(([0], np.cumsum([n for _, n, _ in starts])))[:-1].tolist()
    assert [d for _, _, d in starts] == sorted(d for _, _, d in starts)
    assert held.where("doc_id = 12").count() == 1 and held.where("doc_id = 7777").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_coder_equals_the_library(name, special_as_text):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public.path(name))
    library.encode_special_tokens = special_as_text
    coder = token_files.coder_of(public.path(name), special_as_text)
    rng, end = random.Random(5), np.array([2], "<u4").tobytes()
    alphabet = [" ", "  ", "\n", "a", "b", "'s", "'", "1", "é", "漢", "\x1c", ".", "##", "🙂", "\t", "aa", "zq", "ab ", " \n", "the", "<|endoftext|>", " <|endoftext|>"]
    texts = ["hello <|endoftext|> world", "", " ", "Hello world, hello"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for low in range(0, len(texts), 777):
        some = texts[low : low + 777]
        ids, n = coder.encode_all(some, end)
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in some]


PAGES = [
    (1, "http://a/ü?x=1", "é" * 600),
    (2, "http://b\r\nX: y", "é" * 600),
    (5, None, "é" * 600),
    (5, "again", "é" * 600),
    (3, "http://c", "short"),
    (4, "http://d", "short"),
    (6, "", None),
    (None, "http://e", "é" * 600),
    (None, None, "\r\n\r\nWARC/1.1\r\n\r\n" * 80),
    (8, "http://f%0A", "x" * 300_000),
]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "more") for p in PAGES], "page_id long, url string, html string, offset string").repartition(3)
    path = str(tmp_path / "warc")
    index = warc.write_archives(pages, path)
    got = [(r.page_id, r.url, r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(index, path).collect()]
    want = []
    for page, url, html in PAGES:
        data = (html or "").encode()
        best = max((p for p, _, h in PAGES if p is not None and (h or "") == (html or "")), default=None) if len(data) >= 1000 else None
        revisit = best is not None and page is not None and page < best
        want.append((page, url, "revisit" if revisit else "response", None if revisit else data, len(data), hashlib.sha1(data).hexdigest(), best if revisit else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    some = warc.read_records(index.where("url like '%f%'"), path, gap=0).collect()
    assert [r.page_id for r in some] == [8]


def test_records_have_the_fields_the_format_demands(spark, tmp_path):
    import gzip
    from datetime import datetime, timedelta, timezone

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path), datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone(timedelta(hours=1)))).count()
    data = b"".join(gzip.open(f).read() for f in sorted(tmp_path.glob("*.warc.gz")))
    records = []
    while data:  # one after the other, as a reader without an index has them
        fields = warc.parse(data)
        head, length = data.index(b"\r\n\r\n") + 4, int(fields["Content-Length"])
        assert data[head + length : head + length + 4] == b"\r\n\r\n"
        records.append(fields)
        data = data[head + length + 4 :]
    assert len(records) == len(PAGES) and {f["WARC-Date"] for f in records} == {"2024-01-02T02:04:05Z"}
    ids = {f["WARC-Record-ID"] for f in records}
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest"} <= set(f) for f in records)
    assert all(f["WARC-Refers-To"] in ids for f in records if f["WARC-Type"] == "revisit") and any(f["WARC-Type"] == "revisit" for f in records)
    assert len(ids) == len({(p, h or "") for p, _, h in PAGES})


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(pages, str(tmp_path / "warc")), str(tmp_path / "warc")).collect() == []


def test_tokens_of_nothing(spark, nothing, tmp_path):
    assert bpe.encode(nothing, RANKS, public.PATTERN).collect() == []
    token_files.write_tokens(nothing, str(tmp_path / "t"), public.path("byte_bpe_50k.json"))
    assert token_files.token_starts(token_files.read_tokens(spark, str(tmp_path / "t"))).collect() == []


def test_the_queries_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def test_pipeline_against_its_stages_one_by_one(spark, reference):
    """Every stage on its own input, by the plain versions."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    cuts = quality.cutoffs(quality.signals(spark.read.parquet(f"{sf}/documents.parquet")), labels).collect()
    assert all(r[name] is None for r in cuts for name in quality.RULES)  # too few labels: the base rule alone
    docs = [(d, t) for d, t, _ in docs if not brute.quality(t)[-1]]
    groups = brute.components([(d, brute.fingerprint(t)) for d, t in docs])
    docs = [(d, t) for (d, t), g in zip(docs, groups) if d == g]
    leaking = {r for r, _ in brute.leaks([t for _, t in docs], items)}
    docs = [row for i, row in enumerate(docs) if i not in leaking]
    want = []
    for d, t in docs:
        out, at = "", 0
        for start, _, _, end in brute.secrets(t):
            if end > at:
                out += t[at:start] + "<secret>" if start >= at else ""
                at = end
        t = out + t[at:]
        ids = reference.encode_ordinary(t)
        want.append((d, len(ids), ids, brute.sha(t)))
    got = [(r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 20
