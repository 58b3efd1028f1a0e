"""Uniform shards, ranked search and fill-in-middle against plain versions and exact laws."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from fieldscope.llm import infill, ranking, sharding

# ---- uniform shards


def chi_square(counts, expected):
    return sum((c - e) ** 2 / e for c, e in zip(counts, expected))


def test_every_arrangement_has_the_same_chance():
    sizes, before = np.array([2, 2]), np.array([0, 2, 3, 4])  # four rows in three partitions, two shards of two
    seen = Counter()
    for seed in range(6000):
        placed = []
        for part in range(3):
            shards, keys = sharding.destinations(part, before, sizes, seed)
            placed += list(zip(shards.tolist(), keys.tolist()))
        seen[tuple(sorted(range(4), key=lambda r: placed[r]))] += 1
    assert len(seen) == 24
    assert chi_square(seen.values(), [6000 / 24] * 24) < 52  # 23 degrees of freedom: one in 2,000


def test_matrix_has_the_margins_asked_for():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 400, 37)
    before = np.concatenate(([0], np.cumsum(rows)))
    sizes = np.full(24, before[-1] // 24)
    sizes[: before[-1] % 24] += 1
    matrix = np.array([sharding.matrix_row(p, before, sizes, 5) for p in range(37)])
    assert (matrix >= 0).all() and matrix.sum(1).tolist() == rows.tolist() and matrix.sum(0).tolist() == sizes.tolist()


@pytest.mark.parametrize("good, bad, drawn", [(5, 9, 6), (40, 70, 50), (70, 40, 60), (300, 5, 40), (9, 4000, 900), (200, 300, 490)])
def test_own_draws_follow_the_law(good, bad, drawn):
    rng, n = np.random.default_rng(1), 20_000
    held = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    law = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) * n for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
    assert set(held) <= set(law)
    likely = [k for k in law if law[k] >= 5]
    assert chi_square([held[k] for k in likely], [law[k] for k in likely]) < len(likely) + 5 * math.sqrt(2 * len(likely)) + 5


def test_draws_from_large_populations():
    rng = np.random.default_rng(2)
    good, bad, drawn = 10**12, 3 * 10**12, 2 * 10**12
    held = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)], float)
    variance = drawn * 0.25 * 0.75 * (good + bad - drawn) / (good + bad - 1)
    assert abs(held.mean() - drawn / 4) < 4 * math.sqrt(variance / 4000) and abs(held.var() / variance - 1) < 0.1
    parts = sharding.drawn_from(rng, np.full(24, 10**9), 10**10)
    assert parts.sum() == 10**10 and abs(parts - 10**10 / 24).max() < 10**6


def test_uniform_shards(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 500)  # several pieces a shard
    table = docs.withColumn("Shard", F.lit("own")).withColumn("_cell", F.lit(1))
    done = sharding.uniform_shards(table, str(tmp_path / "s"), shards=5)
    assert set(done.columns) == {*(c for c in table.columns if c != "Shard"), "_shard", "shard", "slot"}
    got = done.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, rows))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(r._shard == "own" for r in got)
    assert [len(slots[s]) for s in range(5)] == [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)]
    held = spark.read.parquet(str(tmp_path / "s" / "shard=2")).withColumn("file", F.input_file_name()).collect()
    files = defaultdict(list)
    for r in held:
        files[r.file].append(r.slot)
    assert len(files) > 1 and [s for f in sorted(files) for s in files[f]] == list(range(len(slots[2])))


def test_shards_of_few_or_no_rows(spark, nothing, tmp_path):
    assert sharding.uniform_shards(nothing, str(tmp_path / "a")).collect() == []
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.shard, r.slot, r.text) for r in sharding.uniform_shards(one, str(tmp_path / "b")).collect()] == [(0, 0, None)]


def test_equal_rows_spread(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7L as doc_id", "'same' as text").repartition(3)
    got = sharding.uniform_shards(docs, str(tmp_path / "s"), shards=3, seed=1).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [1333, 1333, 1334]


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k):
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


def asked(rows):
    texts = [t for _, t in rows if t]
    return [(1, "line one TWO"), (2, None), (3, "  !? "), (4, texts[3]), (4, "café 漢字"), (5, "nowhere-to-be-found"), (None, "x\x0by ALPHA omega"), (6, " ".join(texts[:12])), (6, " ".join(texts[:12])), (7, "the er er er on")]


@pytest.mark.parametrize("piece, tile, k, sets", [(4 << 20, 4 << 20, 10, 4 << 20), (300, 7, 3, 400), (2000, 1, 1, 4 << 20)])
def test_ranked_search(spark, docs, rows, tmp_path, monkeypatch, piece, tile, k, sets):
    monkeypatch.setattr(ranking, "PIECE", piece)
    monkeypatch.setattr(ranking, "TILE", tile)
    monkeypatch.setattr(ranking, "ITEMS", sets)
    ranking.build_index(docs, str(tmp_path / "i"))
    items = spark.createDataFrame([(*i, "x", "y") for i in asked(rows)], "item_id long, text string, bound string, item string")
    got = ranking.search(spark, str(tmp_path / "i"), items, k=k).collect()
    assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == ranked(rows, asked(rows), k)


def test_bound_holds_for_every_document(spark, docs, rows, tmp_path):
    ranking.build_index(docs, str(tmp_path / "i"))
    index = ranking.read_index(spark, str(tmp_path / "i"))
    questions = ranking.Asked([t for _, t in asked(rows)])
    total, _ = ranking.totals(ranking.read_lengths(spark, str(tmp_path / "i")))
    questions.weigh(ranking.document_counts(index, questions), total)
    bounds = ranking.stratum_bounds(index, questions)
    reached = ranking.scored(index, bounds, questions, 100, {}).groupBy("item").agg(F.max("score").alias("best"))
    joined = bounds.groupBy("item").agg(F.max("bound").alias("bound")).join(reached, "item").collect()
    assert joined and all(r.best <= r.bound for r in joined)


def test_ranked_search_of_nothing(spark, nothing, tmp_path):
    ranking.build_index(nothing, str(tmp_path / "i"))
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(spark, str(tmp_path / "i"), items).collect() == []
    ranking.build_index(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), str(tmp_path / "j"))
    assert ranking.search(spark, str(tmp_path / "j"), items.limit(0)).collect() == []


def test_lengths_are_counted_without_a_regular_expression(spark, docs, rows, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("a list of all terms of a text is built to count them")

    monkeypatch.setattr(F, "regexp_count", refuse)
    ranking.build_index(docs, str(tmp_path / "i"))
    lengths = ranking.read_lengths(spark, str(tmp_path / "i")).collect()
    assert {r["n"]: r["docs"] for r in lengths} == Counter(len(terms(t)) for _, t in rows)


@pytest.mark.parametrize("start", [0, 3])
def test_term_numbers_by_slices(start):
    texts = ["ends in a term", "term first", None, "", "é" * 1_500_000, "a b-c_d.e", " 漢字 x\x00y@Z[z`q{r\x7fs", "one two " * 400_000, "é", "A1 ~ \u0080 🙂"]
    got = ranking.term_numbers(pa.array(texts, pa.string())[start:])
    assert got.to_pylist() == [len(terms(t)) for t in texts[start:]]
    assert ranking.term_numbers(pa.array([], pa.string())).to_pylist() == []


def test_equal_rows_are_dealt_over_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "PIECE", 10_000)
    docs = spark.range(3000).selectExpr("7L as doc_id", "'same words' as text").repartition(3)
    ranking.build_index(docs, str(tmp_path / "i"))
    index = ranking.read_index(spark, str(tmp_path / "i"))
    assert index.agg(F.max(F.size("ids"))).first()[0] < 300
    got = ranking.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "same")], "item_id long, text string"), k=4).collect()
    assert got == []  # a term of all documents weighs nothing


# ---- fill-in-middle


def filled(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [(200, "a<P>\nb"), (201, "one\n\n\ntwo\n"), (202, "\n"), (203, "\n\n\n\n"), (204, "<\n<S\nP>\n<M\n>"), (205, "é漢🙂\n" * 40), (206, "no end"), (207, "x\r\ny\x0bz\n" * 9), (208, "long " * 3000 + "\n" + "b" * 900)]


@pytest.mark.parametrize("frame", [4, 7, 64, 1 << 16])
@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0)])
def test_infill(spark, docs, rows, tmp_path, frame, rate, spm):
    if frame < 64:
        rows = [r for r in rows if len(r[1] or "") < 400] + ODD[:-1]
    table = docs.where("text is null or length(text) < 400" if frame < 64 else "true").select("doc_id", "text", "place", "signals")
    table = table.unionByName(spark.createDataFrame([o for o in ODD if frame >= 64 or o[0] != 208], "doc_id long, text string"), allowMissingColumns=True)
    rows = rows if frame < 64 else rows + ODD
    infill.write_frames(table, str(tmp_path / "f"), frame=frame)
    outputs = infill.infill(infill.read_frames(spark, str(tmp_path / "f")), rate=rate, spm=spm)
    want = [(d, *filled(d, t, rate=rate, spm=spm), t or "") for d, t in rows]
    got = [tuple(r) for r in infill.digests(outputs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, n, form, p, m, brute.sha(out), brute.sha(t))) for d, n, form, p, m, out, t in want)
    assert sorted(repr(tuple(r)) for r in infill.texts(outputs).collect()) == sorted(repr((d, form, out)) for d, _, form, _, _, out, _ in want)


def test_frames_are_plain_zstandard_and_seekable(spark, tmp_path):
    text = "".join(f"line {i} é\n" for i in range(3000))
    infill.write_frames(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(tmp_path / "f"), frame=1000)
    row = infill.read_frames(spark, str(tmp_path / "f")).first()
    assert zstandard.ZstdDecompressor().stream_reader(bytes(row.payload), read_across_frames=True).read().decode() == text
    frames = infill.Frames(row.sizes, bytes(row.payload))
    opened = []
    unpack = frames.raw
    frames.raw = lambda f: opened.append(f) or unpack(f)
    f, at = infill.unit_start(1500, row.units, frames)
    assert set(opened) == {f} and len(row.sizes) > 30
    assert b"".join(unpack(i) for i in range(f)) + unpack(f)[:at] == "".join(f"line {i} é\n" for i in range(1500)).encode()


def test_infill_of_nothing(spark, nothing, tmp_path):
    infill.write_frames(nothing, str(tmp_path / "f"))
    assert infill.digests(infill.infill(infill.read_frames(spark, str(tmp_path / "f")))).collect() == []
