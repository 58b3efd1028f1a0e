"""Operators on documents against their plain versions."""

import os
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.llm import decontaminate, licenses, quality, secrets, simhash, substrings, suffixes, trigrams


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(10, 1, 0), (10, 0, 0), (11, 1, 0), (None, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")


def test_quality_signals(docs, rows, labels):
    done = quality.quality_rules(docs, labels)
    assert set(docs.columns) <= set(done.columns)
    got = [(r.doc_id, *r.signals, r.base_failed) for r in done.collect()]
    same(got, [(d, *brute.quality(t)) for d, t in rows])
    assert all(r.kept != r.base_failed for r in done.collect())  # too few labels to certify any cutoff


def test_quality_of_nothing(nothing, labels):
    assert quality.quality_rules(nothing, labels).collect() == []


def test_cutoffs_are_certified(spark):
    rng = np.random.default_rng(5)
    good = [(i, "en" if i % 2 else None, " ".join(f"w{rng.integers(1e6)}" for _ in range(20)) + " #" * int(rng.random() < 0.001)) for i in range(6000)]
    bad = [(10_000 + i, "en", " ".join(f"w{rng.integers(1e6)} ##" for _ in range(20))) for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id < 10000, 1, 0) as quality")
    done = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert not any(done[d] for d, _, _ in bad)
    for stratum in ("en", None):
        own = [done[d] for d, s, _ in good if s == stratum]
        assert own.count(False) <= quality.FALSE_REJECTION * len(own)


def test_rules_of_no_use_are_left_out(spark):
    """Signals that part good from bad no better than chance get no cutoff, though one could be certified."""
    rows = [(i, "en", " ".join("w" * (3 + (i + k) % 5) + str(i * 50 + k) for k in range(20))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 10 = 0, 0, 1) as quality")
    assert quality.quality_rules(docs, labels).where("not kept").count() == 0


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.3), (3, 50, 0.2), (40, 9000, 0.005), (5, 5, 0.5), (0, 0, 0.1)])
def test_binomial_tail(k, n, p):
    from fractions import Fraction
    from math import comb

    exact = float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
    assert quality.binomial_tail(k, n, p) == pytest.approx(exact if k < n * p else 1.0, rel=1e-9)


def test_simhash_components(docs, rows):
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    same(got, [(d, f, c) for (d, f), c in zip(prints, brute.components(prints))])


def test_simhash_links_in_crowded_cells(spark, monkeypatch):
    """A cell that is split into tiles loses no link, and no tile's edges exceed its members."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(1 << 62, size=150)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    from fieldscope.llm import components

    found = {r.node: r.root for r in components.connected(simhash.links(frame)).collect()}
    want = brute.components(list(zip(range(len(prints)), prints)))
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_one_of_each_group(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    groups = brute.components(prints)
    same({r.doc_id for r in kept.collect() if r.doc_id is not None}, set(g for g in groups if g is not None))
    assert kept.count() == len(set(groups))


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.one_of_each(nothing).collect() == []


@pytest.mark.parametrize("sizes", [(4 << 20, 32 << 20), (3000, 2000)])
@pytest.mark.parametrize("width", [50, 7])
def test_word_windows(docs, rows, width, sizes):
    done = substrings.substring_dedup(docs, width, block_bytes=sizes[0], bucket_bytes=sizes[1])
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.text) for r in done.collect()]
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.word_windows(rows, width))])


@pytest.mark.parametrize("sizes", [(4 << 20, 16 << 20), (3000, 2000)])
@pytest.mark.parametrize("length", [100, 32])
def test_byte_strings(docs, rows, length, sizes):
    done = suffixes.substring_dedup(docs, length, block_bytes=sizes[0], bucket_bytes=sizes[1])
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in done.collect()]
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.byte_strings(rows, length))])


def test_long_documents_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 500)
    rows = [(1, "ab" * 400 + "".join(map(str, range(900)))), (2, "z" + "".join(map(str, range(300, 900))))]
    done = suffixes.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in done.collect()]
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.byte_strings(rows))])


@pytest.mark.parametrize("sizes", [(4 << 20, 16 << 20), (3000, 2000)])
@pytest.mark.parametrize("length", [100, 32])
def test_byte_strings_of_hot_anchors(docs, rows, length, sizes, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 1)
    test_byte_strings(docs, rows, length, sizes)


def test_no_bucket_holds_all_runs_of_an_anchor(spark, monkeypatch, tmp_path):
    """One line with other text around it in each document: its runs are dealt over the buckets, with the right result."""
    monkeypatch.setattr(suffixes, "HOT", 50)
    rng = np.random.default_rng(8)
    line = bytes(rng.integers(97, 123, 80, np.uint8)).decode()
    rows = [(i, bytes(rng.integers(65, 91, 150, np.uint8)).decode() + line + bytes(rng.integers(65, 91, 150, np.uint8)).decode() + "=" * (i % 9 * 20)) for i in range(300)]
    deep_shallow, folder = suffixes.deep_shallow, str(tmp_path)

    def watched(text, places, length):
        open(f"{folder}/{len(places)}", "w").close()
        return deep_shallow(text, places, length)

    monkeypatch.setattr(suffixes, "deep_shallow", watched)
    done = suffixes.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=10_000, bucket_bytes=5_000)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in done.collect()]
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.byte_strings(rows))])
    sorted_at_once = [int(p.name) for p in tmp_path.iterdir()]
    assert sorted_at_once and max(sorted_at_once) <= 50 * 51  # an anchor's runs below HOT, of 51 strings each


@pytest.mark.parametrize("length", [100, 32])
def test_byte_strings_of_every_period(spark, length):
    """Lines of each size that stand a few times in a row, alone, and within two documents that hold the same stretch."""
    rng = np.random.default_rng(length)
    rows = []
    for period in range(1, 111):
        line = bytes(rng.integers(97, 123, period, np.uint8)).decode()
        rows.append((4 * period, line * (length // period + 3)))
        other = bytes(rng.integers(65, 91, period, np.uint8)).decode()
        rows += [(4 * period + k, f"{k}#" * 40 + other * (length // period + 2) + f"{k}!" * 40) for k in (1, 2)]
    done = suffixes.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in done.collect()]
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.byte_strings(rows, length))])


def test_deep_shallow_orders_like_sorted():
    rng = np.random.default_rng(1)
    for length in (16, 24, 40, 100):
        for _ in range(25):
            raw = bytes(rng.choice([97, 98], int(rng.integers(length, 300))).astype(np.uint8))
            raw += raw[: int(rng.integers(len(raw)))]
            places = rng.choice(len(raw) - length + 1, min(40, len(raw) - length + 1), replace=False)
            order, equal = suffixes.deep_shallow(np.frombuffer(raw + bytes(8), np.uint8), places, length)
            strings = [raw[p : p + length] for p in places[order]]
            assert strings == sorted(strings)
            assert equal.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


def test_substrings_of_nothing(nothing):
    assert substrings.substring_dedup(nothing).collect() == [] and suffixes.substring_dedup(nothing).collect() == []


def test_secret_spans(docs, rows):
    got = [(r.doc_id, [(s.start, s["rank"], s.kind, s.end) for s in r.spans if s["rank"] < 3]) for r in secrets.secret_spans(docs).collect()]
    same(got, [(d, brute.secrets(t)) for d, t in rows])


def test_secrets_by_every_rule(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890", "AIza" + "x" * 35, "eyJabcdefgh.eyJabcdefgh.sig", "API_KEY=\"abcdef\"", "AKIA" + "Q" * 16, "f" * 24]
    found = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in found}
    for i, kind in enumerate(("private_key", "github", "slack", "google", "jwt", "assign", "access", "hex")):
        assert kind in kinds[i]


PATTERNS = [r.pattern for r in secrets.RULES] + [
    "abc", "a[bc]d|efg+h", "(?:ab|cd){2,}ef", "x(?:foo|bar)?yz[0-9]{3}", "(?i:Key)-(?:one|two|three)\\d+", "a{4}b{0,2}c", "[abc][def][ghi][jkl]end",
    "(?:[a-h]{3}|q)tail", "(?:lead|[a-z]+)(?:er|ing)", "^begin\\b.*?end$", "(?:a|bc|def)(?:g|hi|jkl)", "\u00c9t\u00e9 abc", "(abc)\\1", "(?=abc)abcd", "(?:aaa|aaab)ccc(?:|ddd)", "(?:(?:xy)+z|w)ing",
]


def samples(parsed, draw):
    """A string that the pattern matches, up to assertions, at random."""
    from re import _constants as C

    out = ""
    for op, value in parsed:
        if op is C.LITERAL:
            out += chr(value)
        elif op is C.IN:
            kind, v = draw.choice(value)
            out += chr(v) if kind is C.LITERAL else chr(draw.randint(*v)) if kind is C.RANGE else "7"
        elif op is C.ANY:
            out += draw.choice("xyz ")
        elif op is C.BRANCH:
            out += samples(draw.choice(value[1]), draw)
        elif op is C.SUBPATTERN:
            out += samples(value[3], draw)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            for _ in range(draw.randint(value[0], min(value[1], value[0] + 3))):
                out += samples(value[2], draw)
    return out


def satisfied(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(satisfied(q, text) for q in query[1])


def test_every_match_satisfies_the_query_of_its_pattern():
    import random
    import re

    from re import _parser

    draw, tried = random.Random(5), 0
    for pattern in PATTERNS:
        query = trigrams.trigram_query(pattern)
        for _ in range(400):
            text = samples(_parser.parse(pattern), draw)
            if re.search(pattern, text):
                tried += 1
                assert satisfied(query, ("." + draw.choice([text, text.upper() if "(?i" in pattern else text]) + ".").lower()), (pattern, text, query)
    assert tried > 6000


def test_queries_ask_for_what_patterns_require():
    query = trigrams.trigram_query
    assert query("abcd") == ("and", frozenset(["abc", "bcd"])) and query("[a-z]{24}") is True and query("ab|cde") is True
    assert query("abc|xyz") == ("or", frozenset(["abc", "xyz"])) and query("ab[cd]") == ("or", frozenset(["abc", "abd"]))
    assert query("(?:abc)+") == "abc" and query("abc.*def") == ("and", frozenset(["abc", "def"])) and query("(?:ab)*") is True
    assert query("(?:ab){2,}") == ("and", frozenset(["aba", "bab"])) and query("(?:abc)?") is True
    # what Java alone reads, or reads in its own way
    assert query(r"abc\h+") is True and query("abc[a-z&&[^b]]") is True and query("(?iu:kiss)") is True and query("abc(") is True
    asked = {r.kind: query(r.pattern) for r in secrets.RULES}
    assert asked["hex"] is True and all(q is not True for kind, q in asked.items() if kind != "hex")


def test_rules_of_their_own(spark):
    """Rules that no one spelled out literals for: found by their derived queries as by the pattern alone."""
    import re

    rules = (secrets.Rule("colour", "(?:red|green)-[0-9]{2}"), secrets.Rule("digits", "[0-9]{5}"), secrets.Rule("opt", "ab(?:cd)?ef"))
    texts = ["red-12 green-7 green-77", "12345 abef abcdef", "RED-12", "", None, "abcd ef", "red-\n12 99999 red-00"]
    found = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    want = [(i, sorted((m.start(), n, m.end()) for n, r in enumerate(rules) for m in re.finditer(r.pattern, t or ""))) for i, t in enumerate(texts)]
    same([(r.doc_id, [(s.start, s["rank"], s.end) for s in r.spans]) for r in found], want)
    only = (secrets.Rule("digits", "[0-9]{5}"),)  # nothing to index
    assert sum(len(r.spans) for r in secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), only).collect()) == 2


def test_masked_documents(docs, rows):
    done = secrets.masked(docs)
    assert done.columns == docs.columns

    def masked(text):
        if text is None:
            return None
        out, at = "", 0
        for start, _, _, end in brute.secrets(text):
            if end <= at:
                continue
            out += text[at:start] + "<secret>" if start >= at else ""
            at = end
        return out + text[at:]

    same([(r.doc_id, r.text) for r in done.collect()], [(d, masked(t)) for d, t in rows])


def test_secrets_of_nothing(nothing):
    assert secrets.secret_spans(nothing).collect() == [] and secrets.masked(nothing).collect() == []


@pytest.fixture(scope="module")
def items(spark, rows):
    by_id = dict(rows)
    texts = [by_id[12], by_id[15].upper(), " ".join(by_id[18].split()[:20]), "too short", None, "", by_id[20] + " and much more that no document holds " * 9, by_id[13]]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y")], "item_id long, text string, row_key string"), texts


@pytest.mark.parametrize("small", [True, False])
def test_leaks(docs, rows, items, small, monkeypatch):
    """The same pairs with and without broadcast as a comparison of every item-sized window."""
    from fieldscope.llm import shingles

    monkeypatch.setattr(shingles.sendable, "__defaults__", (shingles.SMALL if small else 0,))
    table, texts = items
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, table).collect()}
    want = {(rows[r][0], i): s for (r, i), s in sorted(brute.leaks([t for _, t in rows], texts).items(), key=lambda x: x[1])}
    assert got == pytest.approx(want) and len(want) > 5


def test_leaks_at_every_start(spark):
    """Items with edited ends, swapped parts, cut off or repeated, each within a longer text: pairs, starts and similarities."""
    item = [f"w{i}" for i in range(40)]
    other = ["of", "them", "of", "them"] * 5
    pad = [f"p{i}" for i in range(30)]
    texts = [pad + x + pad[::-1] for x in (item, item[:-1] + ["edited"], item[:-2] + ["a", "b"], ["edited"] + item[1:], item[20:] + item[:20], item[13:] + item[:13], item + item, other)]
    texts += [item[:-1], item[1:], item[20:] + item[:20], pad + item[:-1], item[1:] + pad, other + other]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other))], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for n, x in enumerate((item, other)):
            for s in range(max(1, len(t) - len(x) + 1)):
                score = brute.leaks([" ".join(t[s : s + len(x)])], [" ".join(x)]).get((0, 0), 0)
                if score > want.get((i, n), (0, 0))[1]:
                    want[i, n] = s, score
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {k: (s, pytest.approx(v)) for k, (s, v) in want.items()} and want[1, 0][0] == 29 and (4, 0) in want


def test_leaks_by_repeated_shingles(spark):
    """Similarity 0.8 and little more, of which one shingle repeated on either side takes a large part: no pair is lost."""
    items, texts = [], []
    for i in range(60):
        shared = [f"s{i}w{k}" for k in range(120)]
        repeated, other = shared + ["xx"] * 14, shared + [f"o{i}w{k}" for k in range(14)]
        items.append((i, " ".join(repeated if i % 2 else other)))
        texts.append((i, " ".join(["before"] * 3 + (other if i % 2 else repeated) + ["after"] * 3)))
    found = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(60)]
    assert all(0.8 <= r.similarity < 0.81 for r in found)


def test_leaks_keep_texts_in_their_rows(spark, docs, rows, items, monkeypatch, tmp_path):
    """No text of a document is written to a work table or shuffled, and a row of many windows counts as many: the same pairs either way."""
    from fieldscope import session
    from fieldscope.llm import shingles

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    table, texts = items
    want = {(rows[r][0], i): s for (r, i), s in brute.leaks([t for _, t in rows], texts).items()}
    got = decontaminate.leaks(docs, table)
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == pytest.approx(want)
    held = [(d.rsplit("-", 1)[0], spark.read.parquet(str(tmp_path / d))) for d in os.listdir(tmp_path)]
    assert [d for d, t in held if any(kind == "array<string>" for _, kind in t.dtypes)] == []
    n_windows, n_rows = max((shingles.total(t, F.size("_asked")), t.count()) for d, t in held if d == "asked-windows")
    assert n_rows < n_windows

    for most, sent in ((n_windows, True), (n_rows, False)):
        monkeypatch.setattr(shingles, "SMALL", most)
        assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, table).collect()} == pytest.approx(want)
        assert sent == (not any(d.startswith("asked-keys") for d in os.listdir(tmp_path)))


def test_elements_are_occurrences(spark):
    lists = [["a"], ["b", "a"], ["x y", "a", "x y", "b", "x y", "a"], ["a"] * 300, [], ["c", "c", "b"]]
    others = [["a"], ["a", "a", "b"], ["x y"] * 2 + ["a"] * 4, ["a"] * 200, ["a"], ["b"]]
    table = spark.createDataFrame(list(zip(lists, others)), "x array<string>, y array<string>")
    got = table.select(decontaminate.elements(F.col("x")).alias("e"), decontaminate.weighted_jaccard(F.col("x"), decontaminate.elements(F.col("y"))).alias("s")).collect()
    for x, y, r in zip(lists, others, got):
        a, b = Counter(x), Counter(y)
        assert sorted(r.e) == sorted(t if k == 1 else f"{t}#{k}" for t, n in a.items() for k in range(1, n + 1))
        assert r.s == sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_count_repeats_as_elements(spark):
    row = spark.sql("select array('a', 'b', 'a', 'a') as x, array('a', 'a', 'b', 'a') as y, array('a', 'b') as z, cast(array() as array<string>) as none")
    x, y, z, none = row.select(*[decontaminate.fingerprint(c) for c in row.columns]).first()
    assert x == y != z and none == 0
    hashes = spark.sql("select array(xxhash64(xxhash64('a'), 0), xxhash64(xxhash64('a'), 1), xxhash64(xxhash64('a'), 2), xxhash64(xxhash64('b'), 0))").first()[0]
    assert x & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)


def test_without_leaks(docs, rows, items):
    table, texts = items
    found = {r for r, _ in brute.leaks([t for _, t in rows], texts)}
    kept = decontaminate.without_leaks(docs, table)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [row for i, row in enumerate(rows) if i not in found])


def test_leaks_of_nothing(docs, nothing, items):
    empty = items[0].limit(0)
    assert decontaminate.leaks(nothing, items[0]).collect() == [] and decontaminate.leaks(docs, empty).collect() == []


def test_licenses(spark, docs):
    found = license_set(licenses.license_matches(docs))
    assert found == {(96, "MIT")}
    table = [(100 * i + k, "pad " * k + text + " tail" * k) for i, (_, text) in enumerate(licenses.TEMPLATES) for k in (0, 3, 11, 40)]
    found = license_set(licenses.license_matches(spark.createDataFrame(table + [(9999, None)], "doc_id long, text string")))
    assert {(d, licenses.TEMPLATES[d // 100][0]) for d, _ in table} <= found


def test_licenses_at_every_place(spark):
    """A notice with up to twelve words inserted in its middle, at every place modulo twice its length: found wherever it stands."""
    notice = next(t for name, t in licenses.TEMPLATES if name == "MIT" and t.startswith("Permission")).split()
    short = "Released under the MIT License".split()
    texts = {}
    for k in range(60):
        for grown in (0, 5, 10, 12):
            texts[k * 100 + grown] = [f"p{i}" for i in range(k)] + notice[:14] + [f"x{i}" for i in range(grown)] + notice[14:] + ["tail"] * (k % 3 * 40)
        texts[k * 100 + 50] = [f"q{i}" for i in range(k)] + short + [f"r{k}n{i}" for i in range(30)]
    found = licenses.license_matches(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.start for r in found if r.license == "MIT"} == {d: d // 100 for d in texts}


def license_set(matches):
    return {(r.doc_id, r.license) for r in matches.collect()}


def test_licenses_of_nothing(nothing, docs, spark):
    assert licenses.license_matches(nothing).collect() == []
    assert licenses.license_matches(docs, spark.createDataFrame([(None, "a b c d e f"), ("x", None), ("y", "a b")], "license string, template string")).collect() == []


def test_a_long_run_of_words_after_a_key_header_is_survived(spark):
    texts = ["-----BEGIN " + "AB " * 200_000, "-----BEGIN " + "AB " * 50_000 + "PRIVATE KEY----- x", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN KEY-----"]
    found = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found} == {0: [], 1: [(0, 150_011 + 16)], 2: [(0, 31)], 3: [(0, 27)], 4: []}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from fieldscope.llm import components

    monkeypatch.setattr(components, "LEAST_SHARE", 3)
    rows = spark.createDataFrame([(k, 100 * k + i) for k, n in ((1, 50), (2, 3), (3, 4), (4, 1)) for i in range(n)], "fp long, row_key long")
    table = rows.groupBy("fp").count().selectExpr("fp", "count as n", "-fp as root")
    joined = components.balanced_join(rows, table, "fp", "row_key", "n", rows.count())
    assert joined.columns == ["fp", "row_key", "root"]
    same([tuple(r) for r in joined.collect()], [(r.fp, r.row_key, -r.fp) for r in rows.collect()])
