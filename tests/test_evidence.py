"""Evidence store, migration, retention, history, metadata."""

import pytest
from pyspark.sql import functions as F

from fieldscope.functions import wording as W
from fieldscope.operators import evidence as S
from fieldscope.operators import history as H
from fieldscope.operators import labels as Lb
from fieldscope.operators.secrets import mask_secrets, secret_key_counts
from fieldscope.session import fresh_dir
from fieldscope.sources.store import EvidenceStore, append_history, clear_table

EXPORT = "id long, account string, created_at long, kind string, title string, path string, content string"


def export(i, content="text", account="a", at=1700000000):
    return (i, account, at + i, "test", f"T{i}", "Test.Path", content)


def legacy(spark):
    row = (
        "a", "OLD-0004", None, "1234567888", None, None, None, {"path": "Legacy.Path", "long": "x" * 3000}, "legacy_test", "Legacy evidence",
        "legacy export", 13, (None, "0.6.0", None, None, "120100", "enUS"), {"preserved": "keep-me"},
    )
    broken = ("a", "OLD-0005", None, "7", None, None, None, None, "k", "t", None, None, None, None)
    partial = ("a", "NEW-1", None, "soon", None, (None, None, "héllo", 1), (None,) * 7, {"path": "P"}, None, None, None, None, None, None)
    return spark.createDataFrame([row, broken, partial], S.STORED)


def test_migration(spark):
    got = {r.ticket: r for r in S.evidence_migrate(legacy(spark)).collect()}
    assert set(got) == {"OLD-0004", "NEW-1"}
    old = got["OLD-0004"]
    assert (old["schema"], old.source.kind, old.source.title, old.source.path) == (W.EVIDENCE_SCHEMA, "legacy_test", "Legacy evidence", "Legacy.Path")
    assert (old.payload.content, old.payload.byte_count, old.environment.version, old.content, old.kind) == ("legacy export", 13, "0.6.0", None, None)
    assert old.extra == {"preserved": "keep-me"} and len(old.metadata["long"]) == 3000
    cut = {r.ticket: r for r in S.evidence_migrate(legacy(spark), 1, 2048).collect()}
    assert cut["OLD-0004"].metadata_cut and not cut["NEW-1"].metadata_cut and len(cut["OLD-0004"].metadata["long"]) == 2048
    new = got["NEW-1"]
    assert (new.created_at, new.payload.byte_count, new.payload.encoding, new.source.kind, new.source.path) == ("0", 6, "utf-8", "unknown", "P")
    assert new.environment.addon_name == W.PRODUCER


def test_migration_is_idempotent(spark):
    once = S.evidence_migrate(legacy(spark))
    assert sorted(map(str, once.collect())) == sorted(map(str, S.evidence_migrate(once.select(*legacy(spark).columns)).collect()))


def test_prune_by_bytes_and_records(spark):
    big = "x" * (9 * 1024 * 1024)
    df = spark.createDataFrame([export(1, big), export(2, big), export(3, "y", "b")], EXPORT)
    assert sorted(r.id for r in S.evidence_prune(df).select("id").collect()) == [2, 3]
    many = spark.createDataFrame([export(i) for i in range(250)], EXPORT)
    assert sorted(r.id for r in S.evidence_prune(many).collect()) == list(range(50, 250))


def test_store_numbers_deletes_clears(spark):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    df = lambda *rows: spark.createDataFrame(list(rows), EXPORT)
    first = store.append(df(export(1), export(2, ""), export(3, at=1700090000))).orderBy("id").collect()
    assert [r.ticket for r in first] == ["FSCOPE-20231114-221321-0001", None, "FSCOPE-20231115-231323-0003"]
    hit = S.evidence_get(store.records(), "a", first[0].ticket)
    assert hit.collect()[0].payload.content == "text"
    assert "PartitionFilters: [isnotnull(created_date" in hit._jdf.queryExecution().executedPlan().toString()
    assert store.delete(df().select("account", F.lit("nope").alias("ticket"))) == 0
    gone = spark.createDataFrame([("a", first[0].ticket), ("a", "nope"), ("b", first[2].ticket)], "account string, ticket string")
    assert store.delete(gone) == 1 and store.delete(gone) == 0
    assert [r.ticket for r in store.records().select("ticket").collect()] == [first[2].ticket]
    assert store.clear() == 1 and store.clear() == 0
    again = store.append(df(export(9), export(10, account="b"))).orderBy("id").collect()
    assert [r.ticket[-4:] for r in again] == ["0004", "0001"]
    store.append(df(export(11)))
    assert store.prune(W.STORE_BYTES, 1) == 1
    assert sorted(r.ticket[-4:] for r in store.records().select("ticket").collect()) == ["0001", "0005"]


def test_accounts_share_tickets(spark):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    store.append(spark.createDataFrame([export(1), export(2, account="b", at=1699999999), export(3, account="b")], EXPORT))
    tickets = {(r.account, r.ticket) for r in store.records().collect()}
    same = "FSCOPE-20231114-221321-0001"
    assert ("a", same) in tickets and ("b", same) in tickets
    assert store.delete(spark.createDataFrame([("a", same)], "account string, ticket string")) == 1
    assert {r.account for r in store.records().collect()} == {"b"}
    assert store.prune(W.STORE_BYTES, 1) == 1 and [r.ticket[-4:] for r in store.records().collect()] == ["0002"]


def test_numbers_of_imported_tickets_are_passed_over(spark):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    store.import_records(spark.createDataFrame([("a", "FSCOPE-20231114-221321-0007", 5, "x"), ("a", "odd", 5, "x")], "account string, ticket string, created_at long, content string"))
    assert [r.ticket[-4:] for r in store.append(spark.createDataFrame([export(1)], EXPORT)).collect()] == ["0008"]
    assert store.clear() == 3
    assert [r.ticket[-4:] for r in store.append(spark.createDataFrame([export(2)], EXPORT)).collect()] == ["0009"]


class Lost(Exception):
    pass


def state(store):
    records = store.records()
    ids = store.last_ids()
    return (
        [] if records is None else sorted((r.account, r.ticket) for r in records.collect()),
        [] if ids is None else sorted((r.account, r.last_id) for r in ids.collect()),
    )


@pytest.mark.parametrize("step", ["_write_ids", "_write_records", "_publish"])
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_lost_at_any_step_leaves_one_snapshot_or_the_other(spark, monkeypatch, step, after):
    path = fresh_dir(spark, "store")
    EvidenceStore(spark, path).append(spark.createDataFrame([export(1), export(2, at=1700090000)], EXPORT))
    old = state(EvidenceStore(spark, path))
    writer = EvidenceStore(spark, path)
    real = getattr(writer, step)

    def lost(*args):
        if after:
            real(*args)
        raise Lost

    monkeypatch.setattr(writer, step, lost)
    with pytest.raises(Lost):
        writer.append(spark.createDataFrame([export(3)], EXPORT))
    published = step == "_publish" and after
    now = state(EvidenceStore(spark, path))
    assert (now == old) != published and len(now[0]) == 2 + published
    if step != "_write_ids":
        gone = spark.createDataFrame([("a", old[0][0][1])], "account string, ticket string")
        with pytest.raises(Lost):
            writer.delete(gone)
        assert len(state(EvidenceStore(spark, path))[0]) == len(now[0]) - published
    # nothing holds the next writer up
    again = EvidenceStore(spark, path).append(spark.createDataFrame([export(4)], EXPORT)).collect()
    assert again[0].ticket.endswith("0004" if published else "0003")


def test_records_without_a_time_can_be_deleted(spark):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    schema = "account string, ticket string, created_at long, content string"
    store.import_records(spark.createDataFrame([("a", "T-1", None, "x"), ("a", "T-2", None, "y"), ("a", "T-3", 5, "z")], schema))
    assert store.delete(spark.createDataFrame([("a", "T-1")], "account string, ticket string")) == 1
    assert sorted(r.ticket for r in store.records().collect()) == ["T-2", "T-3"]


def test_the_second_writer_takes_its_change_up_again(spark, monkeypatch):
    path = fresh_dir(spark, "store")
    first, second = EvidenceStore(spark, path), EvidenceStore(spark, path)
    real, seen = second._publish, []

    def late(version, content):
        if not seen:
            first.append(spark.createDataFrame([export(1)], EXPORT))
        seen.append(version)
        return real(version, content)

    monkeypatch.setattr(second, "_publish", late)
    got = second.append(spark.createDataFrame([export(2)], EXPORT)).collect()
    assert seen == [1, 2] and got[0].ticket.endswith("0002")
    assert [t[-4:] for _, t in state(first)[0]] == ["0001", "0002"] and state(first)[1] == [("a", 2)]


def test_many_small_appends_are_put_together(spark, monkeypatch):
    from fieldscope.sources import store as module

    monkeypatch.setattr(module, "IDS", 2)
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    for i in range(4):
        store.append(spark.createDataFrame([export(i)], EXPORT))
    before = state(store)
    assert len(store.snapshot()[1]["ids"]) <= 2 and len(store.snapshot()[1]["records"]) == 4
    assert store.compact(3) == 1 and store.compact(3) == 0
    assert len(store.snapshot()[1]["records"]) == 1 and state(store) == before and before[1] == [("a", 4)]
    assert store.vacuum(older_s=-5) > 4 and state(store) == before


def test_oversize_is_rejected_but_takes_an_id(spark):
    df = spark.createDataFrame([export(1, "x" * 20), export(2, "y")], EXPORT)
    numbered = S.evidence_number(df)
    assert [r.number for r in S.accepted(numbered, 10).collect()] == [2]


def test_pruned_record_stays_away_after_delete(spark):
    store = EvidenceStore(spark, fresh_dir(spark, "store"))
    store.append(spark.createDataFrame([export(i) for i in range(3)], EXPORT))
    assert store.prune(W.STORE_BYTES, 2) == 1
    newest = store.records().orderBy(F.col("created_at").desc()).select("account", "ticket").limit(1)
    assert store.delete(newest) == 1
    assert store.prune(W.STORE_BYTES, 2) == 0 and store.records().count() == 1


def test_order_pending_chunks(spark):
    records = spark.createDataFrame([("a", "t1", 5), ("a", "t2", 9), ("a", "t3", 9)], "account string, ticket string, created_at long")
    order = spark.createDataFrame([("a", "t1", 1), ("a", "t1", 2), ("a", "gone", 3)], "account string, ticket string, position int")
    got = S.order_reconcile(order, records).orderBy("position").collect()
    assert [(r.ticket, r.was_listed) for r in got] == [("t2", False), ("t3", False), ("t1", True)]
    assert [r.ticket for r in S.evidence_pending(records, order).orderBy("ticket").collect()] == ["t2", "t3"]
    text = "é" * 50000
    chunks = S.export_chunks(spark.createDataFrame([("a", "t", text)], "account string, ticket string, content string")).orderBy("chunk_no").collect()
    assert [len(c.chunk) for c in chunks] == [44000, 44000, 12000]
    assert b"".join(bytes(c.chunk) for c in chunks).decode() == text


def test_kind_labels(spark):
    df = spark.createDataFrame([("performance_health",), ("run_result",), ("?",), (None,)], "k string")
    assert [r.x for r in df.select(S.kind_label(F.col("k")).alias("x")).collect()] == ["Performance Snapshot", "Run Result", "Other Data", "Other Data"]


def test_metadata_bounds(spark):
    wide = ",".join(f'"k{i:02d}":{i}' for i in range(40))
    rows = [(1, '{"s":"%s","n":1.5,"b":false,"z":null,"l":[1],"m":{"x":"y","deep":{"q":1}}}' % ("x" * 3000)), (2, "{%s}" % wide), (3, "no json")]
    got = S.metadata_bound(spark.createDataFrame(rows, "id int, metadata string")).collect()
    one = {r.key_path: (r.type, r.text) for r in got if r.id == 1}
    assert set(one) == {"s", "n", "b", "m", "m.x"} and len(one["s"][1]) == 2048 and one["b"] == ("boolean", "false")
    assert sorted(r.key_path for r in got if r.id == 2) == [f"k{i:02d}" for i in range(32)]
    assert {r.key_path for r in got if r.id == 1 and r.truncated} == {"s"} and all(r.truncated for r in got if r.id == 2)
    whole = S.metadata_bound(spark.createDataFrame(rows, "record_id int, metadata string"), max_entries=None, max_bytes=None).collect()
    assert sum(r.record_id == 2 for r in whole) == 40 and not any(r.truncated for r in whole)
    many = spark.createDataFrame([(i, '{"a":1,"b":{"c":2}}') for i in range(100)], "record_id int, metadata string")
    assert S.metadata_bound(many).count() == 300


def test_metadata_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"a":1}')], "id int, metadata string")
    plan = S.metadata_bound(df)._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("try_parse_json") == 1 and plan.count("map_entries") == 2


def test_history(spark):
    rows = [("a", i, f"code {i}", f"result {i}", "true", str(i)) for i in range(1200)] + [("b", 1, "c" * 13000, None, None, "bad")]
    df = H.history_normalize(spark.createDataFrame(rows, "account string, seq long, code string, result string, succeeded string, timestamp string"))
    long = df.filter("account = 'b'").collect()[0]
    assert long.code == "c" * 12000 + "\n... <truncated>" and (long.result, long.succeeded, long.timestamp) == ("", False, None)
    sized = df.withColumn("bytes", H.entry_bytes(F.lit(None).cast("bigint")))
    kept = H.history_prune(sized).filter("account = 'a'").collect()
    assert len(kept) == 1024 and max(r.seq for r in kept) == 1199
    path = append_history(df.limit(3), fresh_dir(spark, "history"))
    assert clear_table(spark.read.parquet(path), path) == 3 and spark.read.parquet(path).count() == 0


def test_labels(spark):
    rows = [("base", "A", "x %d"), ("enUS", "A", "y %s"), ("base", "B", "b"), ("enUS", "C", "c"), ("base", "D", "d"), ("enUS", "D", "é"), ("base", "E", "%s|%d"), ("enUS", "E", "is %s, %d")]
    df = spark.createDataFrame(rows, "locale string, key string, value string")
    assert {(r.key, r.problem) for r in Lb.label_parity(df).collect()} == {
        ("A", "placeholders"), ("B", "missing_enUS"), ("C", "missing_base"), ("D", "not_ascii"),
    }
    over = Lb.label_overlay(df.filter("locale = 'base'"), df.filter("locale = 'enUS'"))
    assert {(r.key, r.value) for r in over.collect()} == {("A", "y %s"), ("B", "b"), ("C", "c"), ("D", "é"), ("E", "is %s, %d")}


def test_secrets(spark):
    df = spark.createDataFrame([(1, "a", "x", False, False), (1, "b", "y", False, True), (1, "c", "z", True, False)], "p int, key string, value string, key_secret boolean, value_secret boolean")
    assert sorted((r.key, r.value) for r in mask_secrets(df).collect()) == [("a", "x"), ("b", "<secret>")]
    assert secret_key_counts(df, "p").collect()[0].secret_keys == 1
