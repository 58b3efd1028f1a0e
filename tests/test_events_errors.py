"""Event selection, formatting, catalog search, errors."""

import pytest
from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.operators import errors as R
from fieldscope.operators import events as E
from fieldscope.operators.names import name_match_roots

CATALOG = [
    ("ADDON_LOADED", "addOnName"), ("PLAYER_ENTERING_WORLD", ""), ("PLAYER_LOGIN", ""), ("UNIT_HEALTH", "unitTarget"),
    ("UNIT_HEALTH_FREQUENT", "unitTarget"), ("UNIT_MAXHEALTH", "unitTarget"), ("HEALTH", ""),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "event_name string, signature string")


def test_search_ranks_exact_prefix_inner(catalog):
    names = lambda q, n=8: [r.event_name for r in E.catalog_search(catalog, q, n).collect()]
    assert names(" health") == ["HEALTH", "UNIT_HEALTH", "UNIT_HEALTH_FREQUENT", "UNIT_MAXHEALTH"]
    assert names("unit_health") == ["UNIT_HEALTH", "UNIT_HEALTH_FREQUENT"]
    assert names("health", 2) == ["HEALTH", "UNIT_HEALTH"]
    assert names("health", 0) == ["HEALTH"]
    assert names("  ") == []
    assert names("全部")[0] == "ALL"
    assert names("zzz") == []


def test_selection_rules(spark):
    df = spark.createDataFrame([("A",), ("B",), ("B",)], "event string")
    assert E.event_select(df, ["B", "B"]).count() == 2
    assert E.event_select(df, ["A", "ALL"]).count() == 3
    for bad in ([], ["a"], ["A B"], ["1A"]):
        with pytest.raises(E.SelectionError):
            E.event_select(df, bad)
    with pytest.raises(E.SelectionError):
        E.event_select(df, ["A", "NOPE"], df)


def test_bounded_newest_first(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(511)], "session_id int, seq int, ts_us long")
    kept = E.latest_events(df).orderBy("rank").collect()
    assert len(kept) == 500 and kept[0].seq == 510 and kept[-1].seq == 11
    assert E.latest_calls(df).count() == 300


def test_arguments(spark):
    args = [("string", 'a"b\\c\nd'), ("number", "42"), ("nil", None), ("table", None), ("userdata", None), ("secret", "x"), ("boolean", "true")]
    df = spark.createDataFrame([(args,), (args + [("number", str(i)) for i in range(13)],), ([],)], "args array<struct<type:string,text:string>>")
    got = E.formatted(df).collect()
    assert got[0].arguments == ['"a\\"b\\\\c\\\nd"', "42", "nil", "<table>", "<userdata>", "<secret>", "true"]
    assert len(got[1].arguments) == 17 and got[1].arguments[-1] == "<4 more arguments>"
    assert got[2].arguments == [] and got[2].summary == ""
    detail = E.formatted(df).select(E.event_detail(F.lit("X"), F.lit(1.5), F.col("arguments")).alias("d")).collect()
    assert detail[0].d.startswith('Event: X\nElapsed: +1.500 seconds\n\n[1] = "a')
    assert detail[2].d.endswith("This event has no payload.")
    calls = E.formatted(df).select(E.call_detail(F.lit("A.b"), F.lit(0.0), F.col("arguments")).alias("d")).collect()
    assert calls[2].d == "Function: A.b\nElapsed: +0.000 seconds\n\nNo arguments"


@pytest.mark.parametrize("limit", [3, 4, 5, 6, 7, 8, 100])
def test_truncation_keeps_whole_characters(spark, limit):
    text = "aé漢😀bé"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.byte_truncate(F.col("t"), limit, "...").alias("x")).collect()[0].x
    raw = text.encode()
    want = text if len(raw) <= limit else raw[:limit].decode(errors="ignore") + "..."
    assert got == want


def test_text_rules(spark):
    one = lambda expr, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(expr.alias("x")).collect()[0].x
    assert one(T.code_normalize(F.col("c")), c=" /RuN \t print(1)\n") == "print(1)"
    assert one(T.code_normalize(F.col("c")), c="/runner") == "/runner"
    assert one(T.first_line_preview(F.col("c")), c="\r\n\nsecond line that is rather long") == "second line that is ra..."
    assert one(T.first_line_preview(F.col("c")), c="\n") == "(empty)"
    assert one(T.normalize_name(F.col("c")), c="|cffd83b4e[My]|r Add-On 2") == "myaddon2"
    assert one(T.variable_names(F.col("a"), F.col("b")), a="DB, _x1; DB", b="y2 DB 3z") == ["DB", "_x1", "y2", "z"]
    assert one(T.event_name(F.col("c")), c=" 全部事件 ") == "ALL"
    s = one(T.source_attribution(F.col("c")), c="Interface/AddOns/Other/a/b.lua:12: in x")
    assert (s.source, s.source_file) == ("Other", "a\\b.lua:12")
    assert one(T.source_attribution(F.col("c")), c="@FrameXML/x.lua").source == "Blizzard"
    s = one(T.source_attribution(F.col("c")), c="")
    assert (s.source, s.source_file) == ("unknown", "")


def test_times(spark):
    df = spark.createDataFrame([(0,), (-5,), (None,), (1699999999,)], "t long")
    assert [r.x for r in df.select(T.format_time(F.col("t")).alias("x")).collect()] == ["unknown"] * 3 + ["2023-11-14 22:13:19"]


ERRORS = [
    (1, "OtherAddOn failed", "AddOns/OtherAddOn/Core.lua:20", None, 1, 1699999998, "1", None),
    (2, "Main exploded", "AddOns\\Main Dev\\Core.lua:42", "value = nil", 3, 1699999999, "2", None),
    (3, "Network warning", None, None, None, None, "x", "Given"),
]


@pytest.fixture(scope="module")
def errors(spark):
    return spark.createDataFrame(ERRORS, "seq int, message string, stack string, locals string, counter int, time long, session string, source string")


def test_scope_search_source(errors):
    assert [r.seq for r in R.errors_scan(errors).collect()] == [3, 2, 1]
    assert R.errors_scope(errors, "all", 2).count() == 3
    assert [r.seq for r in R.errors_scope(errors, "current", 2).collect()] == [2]
    assert [r.seq for r in R.errors_search(errors, " MAIN ").collect()] == [2]
    assert R.errors_search(errors, "").count() == 3
    assert [r.s for r in errors.orderBy("seq").select(R.error_source().alias("s")).collect()] == ["OtherAddOn", "Main", "Given"]


def test_report(errors):
    got = {r.seq: r.x for r in errors.select("seq", R.error_report("1.0", "7", "today", "enUS").alias("x")).collect()}
    assert "Main exploded" in got[2] and "value = nil" in got[2] and "Occurrences: 3" in got[2] and "Capture session: 2" in got[2]
    assert "Locals" not in got[1]
    assert "Stack Trace\nNot available" in got[3] and "Time: Unknown time" in got[3] and "Capture session: -1" in got[3]


def test_occurrences(errors):
    again = errors.unionByName(errors.withColumn("seq", F.col("seq") + 10))
    got = {r.message: r for r in R.error_occurrences(again).collect()}
    assert got["Main exploded"].occurrences == 6 and got["Network warning"].occurrences == 2
    assert got["Main exploded"].latest_seq == 12


def test_name_matches_against_all_pairs(spark):
    keys = ["MyAddon", "MyAddonDB", "my_addon_cache", "addon", "My", "other", "OTHERS", "xOtherx", "abc"]
    addons = ["My Addon", "|cff000000Other|r", "abc", "Addon"]
    norm = lambda s: "".join(c for c in s.lower().replace("|cff000000", "").replace("|r", "") if c.isalnum())
    want = set()
    for a in addons:
        hits = sorted(k for k in keys if len(norm(k)) >= 4 and len(norm(a)) >= 4 and (norm(a) in norm(k) or norm(k) in norm(a)))
        want |= {(a, k) for k in hits[:3]}
    got = name_match_roots(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(a,) for a in addons], "addon string"), 3)
    assert {(r.addon, r.key) for r in got.collect()} == want
