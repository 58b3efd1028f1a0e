"""Trees, documents, graphs, closures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import documents as D
from fieldscope.operators import json_index
from fieldscope.operators import graph as G
from fieldscope.operators import trees as T

NODE = "id long, parent_id long, key string, kind string, value string"
# {Alpha, Alphabet, BetaAlpha, Nested{Value, Controls{UpdateAddButton}}} below a root, and a second root.
DOCUMENT = [
    (1, None, "TestRoot", "table", ""), (2, 1, "Alpha", "number", "1"), (3, 1, "Alphabet", "number", "2"), (4, 1, "BetaAlpha", "number", "3"),
    (5, 1, "Nested", "table", ""), (6, 5, "Value", "string", "ok"), (7, 5, "Controls", "table", ""), (8, 7, "UpdateAddButton", "function", "f"),
    (9, 7, "a key", "string", "x"), (10, 5, "3", "string", "three"), (20, None, "Other", "table", ""), (21, 20, "nested", "number", "1"),
]


@pytest.fixture(scope="module")
def placed(spark):
    return T.ancestry(spark.createDataFrame(DOCUMENT, NODE)).withColumn("doc_id", F.col("chain")[0]["id"]).withColumn("path", T.key_path()).cache()


def test_flatten_in_pre_order(spark):
    flat = T.tree_flatten(spark.createDataFrame(DOCUMENT, NODE)).filter("doc_id = 1").orderBy("position").collect()
    assert [r.id for r in flat] == [1, 2, 3, 4, 5, 10, 7, 8, 9, 6]
    assert [r.depth for r in flat] == [0, 1, 1, 1, 1, 2, 2, 3, 3, 2] and not flat[0].truncated


def test_flatten_bounds(spark):
    chain = [(i, i - 1 if i else None, f"k{i}", "table", "") for i in range(14)]
    flat = T.tree_flatten(spark.createDataFrame(chain, NODE), max_depth=8).collect()
    assert sorted(r.depth for r in flat) == list(range(9)) and all(r.truncated for r in flat)
    whole = T.tree_flatten(spark.createDataFrame(chain, NODE)).orderBy("position").collect()
    assert [r.depth for r in whole] == list(range(14)) and not any(r.truncated for r in whole)
    counts = T.graph_counts(spark.createDataFrame(chain, NODE), 0).collect()[0]
    cut = T.graph_counts(spark.createDataFrame(chain, NODE), 0, max_depth=8).collect()[0]
    assert (counts.entries, counts.truncated, cut.entries, cut.truncated) == (13, False, 8, True)
    wide = [(0, None, "r", "table", "")] + [(i, 0, f"k{i:03d}", "string", "v" * 600) for i in range(1, 251)]
    assert T.tree_flatten(spark.createDataFrame(wide, NODE)).count() == 251
    flat = T.tree_flatten(spark.createDataFrame(wide, NODE), max_entries=200).collect()
    assert len(flat) == 201 and all(r.truncated for r in flat) and max(len(r.value) for r in flat) == 515
    few = T.tree_flatten(spark.createDataFrame(wide, NODE), max_entries=300, max_nodes=100).collect()
    assert len(few) == 100 and all(r.truncated for r in few)


def test_cycles_have_no_root(spark):
    df = spark.createDataFrame([(1, 2, "a", "table", ""), (2, 1, "b", "table", ""), (3, None, "c", "table", ""), (4, 99, "lost", "table", "")], NODE)
    assert [r.id for r in T.ancestry(df).collect()] == [3]
    assert {(r.id, r.marker) for r in T.cyclic_nodes(df).collect()} == {(1, "<cycle>"), (2, "<cycle>")}
    long = [(i, (i + 1) % 7, f"k{i}", "table", "") for i in range(7)] + [(50 + i, 49 + i if i else 3, "x", "string", "") for i in range(9)]
    assert T.cyclic_nodes(spark.createDataFrame(long, NODE)).count() == 16 and T.ancestry(spark.createDataFrame(long, NODE)).count() == 0


def test_keys_are_ordered_by_type_and_value(spark):
    rows = [(0, None, "r", "table", "")] + [(i + 1, 0, k, "string", "") for i, k in enumerate(["10", "2", "b", "-1", "a"])]
    flat = T.tree_flatten(spark.createDataFrame(rows, NODE)).orderBy("position").collect()
    assert [r.key for r in flat] == ["r", "-1", "2", "10", "a", "b"]
    pages = T.child_pages(spark.createDataFrame([(1, i, k) for i, k in enumerate(["10", "2", "b", "-1", "a"])], "parent_id int, id int, key string"))
    assert [r.key for r in pages.orderBy("position").collect()] == ["-1", "2", "10", "a", "b"]


def test_paths(placed):
    got = {r.id: r for r in placed.select("id", T.breadcrumb(F.col("path")).alias("b"), T.access_path(F.col("path")).alias("a")).collect()}
    assert got[9].b == 'TestRoot / Nested / Controls / ["a key"]' and got[9].a == 'TestRoot.Nested.Controls["a key"]'


def test_key_search(placed):
    hits = T.key_search(placed, "alpha").filter("doc_id = 1").orderBy("rank").collect()
    assert [r.key for r in hits] == ["Alpha", "Alphabet", "BetaAlpha"] and hits[0].total_matches == 3
    assert [r.keys[1:] for r in T.key_search(placed, "add").collect()] == [["Nested", "Controls", "UpdateAddButton"]]
    limited = T.key_search(placed, "alpha", limit=1).collect()
    assert [(r.key, r.total_matches) for r in limited] == [("Alpha", 3)]
    with pytest.raises(ValueError):
        T.key_search(placed, " ")


def test_search_fallback(spark, placed):
    asked = spark.createDataFrame([(1, "nested", 20), (2, "Alpha", 20), (3, "add", 5), (4, "zzz", 1)], "query_id int, needle string, scope_id long")
    got = T.search_fallback(placed, asked).collect()
    assert {(r.query_id, r.scope, r.id) for r in got} == {(1, "local", 21), (2, "global", 2), (2, "global", 3), (2, "global", 4), (3, "local", 8)}
    many = spark.createDataFrame([(i, "nested" if i % 2 else "n", 20) for i in range(1500)], "query_id int, needle string, scope_id long")
    assert T.search_fallback(placed, many).select("query_id").distinct().count() == 1500


def test_path_resolve(spark, placed):
    paths = {
        "_G.TestRoot.Nested.Value": 6, " TestRoot['Nested'].Controls[\"a key\"] ": 9, "TestRoot.Nested[3]": 10, "TestRoot.Nested.3": "path_invalid",
        'TestRoot.Nested["3"]': "not_found", "TestRoot..Nested": "path_invalid", "TestRoot.": "path_invalid", "": "path_required", "TestRoot.Nope": "not_found",
        ".TestRoot": 1, "Test Root": "path_invalid", "TestRoot[3]Value": "path_invalid",
    }
    asked = spark.createDataFrame([(i, 1, p) for i, p in enumerate(paths)], "request_id int, doc_id long, path string")
    elsewhere = asked.filter("request_id < 2").withColumn("doc_id", F.lit(20).cast("long"))
    assert {r.status for r in T.path_resolve(elsewhere, placed).collect()} == {"not_found"}
    got = {r.request_id: r.id if r.status == "found" else r.status for r in T.path_resolve(asked, placed).collect()}
    assert [got[i] for i in range(len(paths))] == list(paths.values())


def test_pages(spark):
    children = spark.createDataFrame([(1, i, f"field{i}") for i in range(450)] + [(2, 900, "x")], "parent_id int, id int, key string")
    got = T.child_pages(children).filter("parent_id = 1").orderBy("position").collect()
    assert [r.key for r in got] == sorted(f"field{i}" for i in range(450))
    ends = {r.page: (r.loaded_count, r.has_more) for r in got}
    assert ends == {0: (200, True), 1: (400, True), 2: (450, False)}


def test_canonical_key_order(spark):
    rows = [(1, "string", None, "b"), (2, "number", 10.0, ""), (3, "number", -2.0, ""), (4, "boolean", None, "1"), (5, "boolean", None, "0"), (6, "secret", None, ""), (7, "function", None, "f"), (8, "string", None, "a")]
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, id int, key_type string, number double, text string")
    assert [r.id for r in T.canonical_key_order(df, ["g"]).orderBy("position").collect()] == [6, 3, 2, 8, 1, 5, 4, 7]


def structural_bytes(value, depth=0):
    """The size rule, written out for JSON values."""
    if isinstance(value, dict):
        pairs = value.items()
    elif isinstance(value, list):
        pairs = enumerate(value, 1)
    else:
        return len(value.encode()) if isinstance(value, str) else 8
    return 48 + sum(16 + structural_bytes(k) + structural_bytes(v) for k, v in pairs)


def test_document_footprint(spark):
    docs = {"a": {"records": [{"value": "x" * 32}], "enabled": True}, "b": {"é": 'q"\n\\', "n": None, "f": 1.5}, "c": "text", "d": []}
    rows = [("o", name, json.dumps(doc)) for name, doc in docs.items()]
    have = spark.createDataFrame(rows, "owner string, name string, content string")
    declared = spark.createDataFrame([("o", n) for n in [*docs, "never"]], "owner string, name string")
    got = {r.name: r for r in D.document_footprint(D.document_scan(have, declared)).collect()}
    for name, doc in docs.items():
        assert got[name].bytes == structural_bytes(doc), name
    assert (got["never"].bytes, got["never"].loaded, got["a"].tables, got["a"].entries) == (8, False, 3, 4)


def test_node_footprint(spark):
    r = {x.root_id: x for x in T.footprint(spark.createDataFrame(DOCUMENT, NODE), root_depth=0).collect()}[20]
    assert (r.bytes, r.tables, r.entries, r.strings) == (48 + 16 + 6 + 8, 1, 1, 1)
    cut = {x.root_id: x for x in T.footprint(spark.createDataFrame(DOCUMENT, NODE), root_depth=0, max_entries=2).collect()}[1]
    assert cut.truncated and cut.entries == 2


def test_variant_nodes(spark):
    deep = "{}"
    for _ in range(12):
        deep = '{"x":%s}' % deep
    docs = [(1, '{"b":[10,{"k":null}],"a":"t","2":true}'), (2, "{broken"), (3, deep), (4, json.dumps({f"k{i:03d}": i for i in range(230)})), (5, "7")]
    flat = D.variant_nodes(spark.createDataFrame(docs, "doc int, body string"), "doc", "body").orderBy("doc", "position").collect()
    one = [("/".join(r.path), r.kind, r.value) for r in flat if r.doc == 1]
    assert one == [("", "table", "Table"), ("2", "boolean", "true"), ("a", "string", '"t"'), ("b", "table", "Table"), ("b/1", "number", "10"), ("b/2", "table", "Table"), ("b/2/k", "nil", "nil")]
    assert not [r for r in flat if r.doc == 2]
    assert max(r.depth for r in flat if r.doc == 3) > 8 and not any(r.truncated for r in flat if r.doc in (3, 4))
    flat = D.variant_nodes(spark.createDataFrame(docs, "doc int, body string"), "doc", "body", max_depth=8, max_entries=200).collect()
    assert max(r.depth for r in flat if r.doc == 3) == 8 and all(r.truncated for r in flat if r.doc == 3)
    four = [r for r in flat if r.doc == 4]
    assert len(four) == 201 and four[0].truncated
    assert [(r.kind, r.value) for r in flat if r.doc == 5] == [("number", "7")]


def test_canonical_text(spark):
    docs = [(1, '{"b":2,"a":{"x":[1,"q\\"\\n"]},"e":{}}'), (2, '{"e":{},"a":{"x":[1,"q\\"\\n"]},"b":2}'), (3, "[[[[[[[1]]]]]]]"), (4, "nope")]
    df = spark.createDataFrame(docs, "id int, body string")
    got = {r.id: r.text for r in D.canonical_documents(df, "id", "body").collect()}
    assert got[1] == got[2] == '{\n  ["a"] = {\n    ["x"] = {\n      [1] = 1,\n      [2] = "q\\"\\\n",\n    },\n  },\n  ["b"] = 2,\n  ["e"] = {},\n}'
    assert got[3].count("{") == 7 and "[1] = 1," in got[3] and 4 not in got
    shallow = {r.id: r for r in D.canonical_documents(df, "id", "body", max_depth=2).collect()}
    assert "<max depth>" in shallow[3].text and shallow[3].truncated
    same = {r.first_id: r.copies for r in D.fingerprints(df, "id", "body").collect()}
    assert same == {1: 2, 3: 1}
    wide = json.dumps({f"streamField{i}": "v" * 16 for i in range(3000)})
    one = spark.createDataFrame([(1, wide), (2, json.dumps({"a": list(range(5)), "b": 1}))], "id int, body string")
    few = {r.id: r for r in D.canonical_documents(one, "id", "body", max_entries=4).collect()}
    assert few[1].text.endswith("\n  ... <2996 entries omitted>\n}") and few[1].truncated
    assert few[2].text == '{\n  ["a"] = {\n    [1] = 0,\n    [2] = 1,\n    [3] = 2,\n    [4] = 3,\n    ... <1 entries omitted>\n  },\n  ["b"] = 1,\n}'
    full = D.canonical_documents(one, "id", "body").filter("id = 1").collect()[0]
    assert '["streamField2999"]' in full.text and len(full.text) > 44000 and not full.truncated
    assert D.canonical_documents(one, "id", "body", max_bytes=1000).filter("id = 1").collect()[0].text.endswith("\n... <output truncated>")
    far = [(i, json.dumps({"t": "x" * 50000 + str(i)})) for i in range(2)]
    assert D.fingerprints(spark.createDataFrame(far, "id int, body string"), "id", "body").count() == 2


def test_numbers_in_canonical_text(spark):
    values = [1.5, -2.25, 1e3, 1.5e-7, 0.1, 100.0, 123456.789, 1e-4, 12345678901234.75, 0.0, -0.5, -3.25e-9]
    df = spark.createDataFrame([(i, json.dumps([v])) for i, v in enumerate(values)] + [(99, "[12345678901234567890, 7]")], "id int, body string")
    got = {r.id: r.text for r in D.canonical_documents(df, "id", "body").collect()}
    for i, v in enumerate(values):
        assert got[i] == "{\n  [1] = %.14g,\n}" % v, v
    assert "[1] = 12345678901234567890," in got[99] and "[2] = 7," in got[99]


def test_wide_objects_stay_linear(spark):
    import time

    spent = []
    for n in (2000, 16000):
        df = spark.createDataFrame([(1, json.dumps({f"k{i}": i for i in range(n)}))], "id int, body string")
        began = time.time()
        assert D.variant_nodes(df, "id", "body").count() == n + 1
        spent.append(time.time() - began)
    assert spent[1] < 20


def test_tree_from_text(spark):
    rows = [
        (1, 'printed\n[1] = {\n  ["player"] = {\n    ["level"] = 80,\n    ["my name"] = "Fo\\"l, {x}",\n  },\n  ... <3 entries omitted>\n}\n[2] = nil\n[3] = <cycle>'),
        (2, "legacy result"), (3, '[1] = {\n  ["a"] = '), (4, "[1] = true"), (5, None), (6, "[2] = 1"),
    ]
    got = D.tree_from_text(spark.createDataFrame(rows, "id int, body string"), "body", ["id"]).orderBy("id", "position").collect()
    assert [("/".join(r.path), r.kind, r.value) for r in got if r.id == 1] == [
        ("[1]", "table", "Table (2 entries)"), ("[1]/player", "table", "Table (2 entries)"), ("[1]/player/level", "number", "80"),
        ('[1]/player/["my name"]', "string", '"Fo\\"l, {x}"'), ("[1]/...", "marker", "... <3 entries omitted>"), ("[2]", "nil", "nil"), ("[3]", "marker", "<cycle>"),
    ]
    assert {r.id for r in got} == {1, 4}


def test_canonical_text_parses_back(spark):
    doc = {"name": "x", "list": [1, 2.5, None, True], "inner": {"k y": "v"}}
    text = D.canonical_documents(spark.createDataFrame([(1, json.dumps(doc))], "id int, body string"), "id", "body").collect()[0].text
    rows = D.parse_tree("[1] = " + text)
    assert [(parent, key) for parent, _, key, _, _ in rows][:3] == [(-1, "[1]"), (0, "inner"), (1, '["k y"]')] and len(rows) == 9


def test_deep_texts_have_their_tree(spark):
    deep = lambda n: "[1] = " + '{\n["x"] = ' * n + "1" + "\n}" * n
    df = spark.createDataFrame([(1, deep(50_000)), (2, "[1] = 5"), (3, deep(50_000)[:-1])], "id int, body string")
    got = {r.id: (r.n, r.d) for r in D.tree_from_text(df, "body", ["id"], paths=False).groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert got == {1: (50_001, 50_000), 2: (1, 0)}
    some = D.tree_from_text(spark.createDataFrame([(1, deep(1500))], "id int, body string"), "body", ["id"])
    assert some.where("size(path) = depth + 1 and path[0] = '[1]' and path[depth] = key").count() == 1501
    assert [(r.parent, r.position) for r in some.orderBy("position").limit(3).collect()] == [(None, 0), (0, 1), (1, 2)]


def test_values_are_cut_by_argument_only(spark):
    df = spark.createDataFrame([(1, '[1] = "' + "é" * 600 + '"')], "id int, body string")
    whole, cut = (D.tree_from_text(df, "body", ["id"], value_bytes=b).collect()[0] for b in (None, 10))
    assert len(whole.value) == 602 and not whole.cut and cut.value == '"éééé...' and cut.cut


def test_json_of_great_depth_costs_only_itself(spark):
    flat = spark.range(20_000).selectExpr("cast(id as int) as id", "concat('{\"a\":', id, ',\"b\":[1,\"x\"]}') as body")
    deep = spark.createDataFrame([(-1, '{"k":' * 900 + "1" + "}" * 900), (-2, "[" * 70_000), (-3, "[" * 5000 + "]" * 5000)], "id int, body string")
    nodes = D.variant_nodes(flat.where("id < 100").union(deep), "id", "body")
    shallow = D.variant_nodes(flat, "id", "body")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(nodes) < plan(shallow) + 10
    got = {r.id: (r.n, r.d) for r in nodes.where("id < 2").groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert got == {-1: (901, 900), -3: (5000, 4999), 0: (5, 2), 1: (5, 2)}
    text = D.canonical_documents(deep.where("id = -1"), "id", "body").first().text
    assert text.count("{") == text.count("}") == 900 and '["k"] = 1,\n' in text


def _pre_order(value, path=()):
    kind = "table" if isinstance(value, (dict, list)) else "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "nil" if value is None else "number"
    out = [(list(path), kind, value if kind == "string" else None)]
    below = sorted(value.items(), key=lambda e: e[0].encode()) if isinstance(value, dict) else enumerate(value, 1) if isinstance(value, list) else ()
    for key, inner in below:
        out += _pre_order(inner, (*path, str(key)))
    return out


def test_json_index_against_a_parser():
    import random

    import pyarrow as pa

    rng = random.Random(3)

    def some(depth):
        r = rng.random()
        if depth < 5 and r < 0.3:
            return {rng.choice(["a", "b", "é", 'q"x', "\\", "n\n", "zz", "", "\u2028"]) + str(rng.randint(0, 3)): some(depth + 1) for _ in range(rng.randint(0, 5))}
        if depth < 5 and r < 0.5:
            return [some(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, -2.5, True, False, None, "", "x", "\\\\", 'a"b', "{[,:]}", "ß é\t", 1e300, "end\\"])

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    def damaged(text):
        at = rng.randrange(len(text) + 1)
        return text[:at] + rng.choice(["", *'{}[],:"\\ 1atn']) + text[at + rng.randint(0, 1) :]

    texts = [json.dumps(some(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(1500)]
    texts += [damaged(t) for t in texts] + ["", None, "\\", '"\\', '"a"', " 7 ", "nul", "[1,]", '{"a":1,"a":2}', "[NaN]", "01", '"\x01"', "]["]
    for first, end, data, offsets in json_index.slices(pa.array(texts)):
        nodes = json_index.nodes_of(data, offsets)
        got = {}
        for doc, *row in zip(nodes.doc.tolist(), json_index.paths(nodes).to_pylist(), nodes.kind.to_pylist(), nodes.raw.to_pylist()):
            got.setdefault(doc, []).append((row[0], row[1], row[2] if row[1] == "string" else None))
        for i, text in enumerate(texts[first:end]):
            try:
                want = _pre_order(json.loads(text or "", object_pairs_hook=once, parse_constant=lambda c: json.loads("")))
            except ValueError:
                want = None
            assert got.get(i) == want, text


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (1, 3), (1, 3)] + [(i, i + 1) for i in range(4, 20)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (1,)], "id long")
    got = {r.id: r.depth for r in G.graph_reach(edges, roots, 4).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
    bounded = G.bounded_reach(G.graph_reach(edges, roots, 4), 3).collect()
    assert [r.id for r in bounded] == [1, 2, 3] and bounded[0].truncated


def shortest(edges, roots, limit=None):
    depth, level = {r: 0 for r in roots}, list(roots)
    while level and (limit is None or depth[level[0]] < limit):
        after = []
        for a in level:
            for b in edges.get(a, ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    after.append(b)
        level = after
    return depth


@pytest.mark.parametrize("limit", [None, 7])
def test_graph_reach_over_chains_rings_and_branches(spark, limit):
    """Chains of all lengths between random nodes, two ways of different length, rings, loops, repeated edges, roots inside a chain."""
    rng = random.Random(11)
    pairs, fresh = [(rng.randrange(25), rng.randrange(25)) for _ in range(30)], iter(range(100, 10**6))
    for length in (1, 2, 3, 5, 8, 13, 30):
        a, b = rng.randrange(25), rng.randrange(25)
        nodes = [a, *(next(fresh) for _ in range(length)), b]
        pairs += zip(nodes, nodes[1:])
    pairs += [(50, 51), (51, 52), (52, 50), (60, 60), (0, 70), (70, 70), (0, 71), (71, 72), (72, 73), (0, 73), (73, 74), (None, 1), (1, None)] + pairs[:5]
    inside = pairs[60][0] if pairs[60][0] is not None else 0
    roots = [0, 51, inside, 999_999]
    graph = {}
    for a, b in pairs:
        if a is not None and b is not None:
            graph.setdefault(a, set()).add(b)
    got = G.graph_reach(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(r,) for r in roots + roots], "id long"), limit).collect()
    want = shortest(graph, dict.fromkeys(roots), limit)
    assert len(got) == len(want) and {r.id: r.depth for r in got} == want
    assert {r.id for r in got if r.truncated} == {a for a in want if want[a] == limit and any(b not in want for b in graph.get(a, ()))}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    steps = []
    add = G._Levels.add
    monkeypatch.setattr(G._Levels, "add", lambda self, df, number: steps.append(number) or add(self, df, number))
    pins = []
    monkeypatch.setattr(G, "pin", lambda df, label, pin=G.pin: pins.append(label) or pin(df, label))
    n = 10_000
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    got = G.graph_reach(edges, spark.createDataFrame([(0,)], "id long"))
    assert got.where("depth = id").count() == got.count() == n + 1
    assert len(steps) <= 3 and pins.count("chain-hops") <= 16


def test_load_closure(spark):
    entries = spark.createDataFrame([(0, "a.xml"), (0, "z.lua"), (0, "a.xml"), (1, "none.lua")], "build int, path string")
    references = spark.createDataFrame(
        [("a.xml", "ui\\B.xml"), ("a.xml", "../out.lua"), ("ui/b.xml", "c.lua"), ("ui/b.xml", "../A.xml"), ("ui/b.xml", "./missing.lua"), ("z.lua", "never.lua")],
        "src string, reference string",
    )
    files = spark.createDataFrame([("a.xml",), ("ui/b.xml",), ("ui/c.lua",), ("z.lua",), ("never.lua",)], "path string")
    loaded, findings = G.load_closure(entries, references, files)
    assert sorted((r.build, r.path, r.depth) for r in loaded.collect()) == [(0, "a.xml", 0), (0, "ui/b.xml", 1), (0, "ui/c.lua", 2), (0, "z.lua", 0)]
    assert sorted((r.build, r.finding, r.path) for r in findings.collect()) == [
        (0, "load-path-escape", "../out.lua"), (0, "missing-load-file", "ui/missing.lua"), (1, "missing-load-file", "none.lua"),
    ]


def test_owner_frames(spark):
    objects = spark.createDataFrame([(1, "Interface\\AddOns\\Mine\\a.lua:1"), (2, "Interface/AddOns/Other/a.lua:1"), (3, None)], "object_id long, location string")
    reached = spark.createDataFrame([(1,), (9,)], "id long")
    got = {r.object_id: (r.via_graph, r.via_source) for r in G.owner_frames(objects, "Mine", reached).collect()}
    assert got == {1: (1, 1), 9: (1, 0)}


def test_search_fallback_repeats_no_search(spark, placed):
    """Needles that share their first letters, many queries of one search: pairs are made per search, not per query."""
    needles = ["n", "ne", "nes", "nest", "nested", "nestor", "alpha", "alphabet", " ADD ", ""]
    asked = spark.createDataFrame([(i, needles[i % 10], (20, 1, 5, None)[i // 10 % 4]) for i in range(400)], "query_id int, needle string, scope_id long")
    rows = placed.collect()
    want = set()
    for q in asked.collect():
        needle = q.needle.strip().lower()
        hits = [r for r in rows if needle and needle in r.key.lower()]
        near = [r for r in hits if q.scope_id in [c.id for c in r.chain[:-1]]]
        chosen = near or [r for r in hits if r.depth == 1]
        want |= {(q.query_id, "local" if near else "global", r.id, len(chosen)) for r in chosen}
    assert {(r.query_id, r.scope, r.id, r.total_matches) for r in T.search_fallback(placed, asked).collect()} == want
    lows, long = spark.createDataFrame([("abcdef",), ("xyzabc",)], "low string"), spark.createDataFrame([(f"abc{i}",) for i in range(3000)] + [("abc",)], "needle string")
    held = T._holding(lows, long)
    assert sorted(tuple(r) for r in held.collect()) == [("abcdef", "abc"), ("xyzabc", "abc")]
    assert "Contains(" not in held._jdf.queryExecution().analyzed().toString()  # needles of the same beginning are not tried one by one


def test_nodes_of_one_file_are_placed_by_all_cores(spark):
    from workloads import views

    nodes = views.nodes(spark, "/root/testdata/sf0.001")
    assert nodes.rdd.getNumPartitions() == 1
    placed = T.ancestry(nodes)
    assert placed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and placed.count() == nodes.count()


def test_text_that_is_no_token_gives_no_tree(spark):
    rows = [(1, '[1] = "open'), (2, "[1] = {a'"), (3, '[1] = "a\\"b" \t\n'), (4, "[1] = 'it''s'")]
    got = D.tree_from_text(spark.createDataFrame(rows, "id int, body string"), "body", ["id"]).collect()
    assert [(r.id, r.kind, r.value) for r in got if r.id != 4] == [(3, "string", '"a\\"b"')]
