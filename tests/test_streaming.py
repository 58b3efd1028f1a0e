"""Streams against the batch operators on the same rows, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import errors as R
from fieldscope.operators import events as E
from fieldscope.operators import lifecycle as L
from fieldscope.operators.thinning import downsample_gap
from fieldscope.session import fresh_dir
from fieldscope.streaming import captures as C
from fieldscope.streaming import merged as M
from fieldscope.streaming import runner as S


def staged(spark, parts, schema):
    """A folder with one file per part, oldest first, and a stream that reads one per micro-batch."""
    path = fresh_dir(spark, "staged")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return S.table_stream(spark, path, files_per_batch=1), spark.read.parquet(path)


def test_ring_equals_batch(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, i * 10 + rng.randrange(30), f"E{i % 4}") for i in range(300)]
    stream, batch = staged(spark, [rows[:120], rows[120:130], rows[130:]], "session_id long, seq long, ts_us long, event string")
    changes = S.run_to_table(C.ring_state_stream(stream, 20, 3), "ring")
    got = C.ring_contents(changes, 20)
    want = E.newest_records(batch, 20)
    read = lambda df: sorted((r.session_id, r["rank"], r.seq, r.event) for r in df.collect())
    assert read(got) == read(want) and len(read(got)) == 60
    entered = changes.collect()
    assert len(entered) == len({r.seq for r in entered}) <= len(rows)  # nothing is reported twice


def test_object_state_equals_batch(spark):
    rng = random.Random(5)
    rows = [(s, o, n, rng.random() < 0.5) for s in (1, 2) for n in range(12) for o in range(15) if rng.random() < 0.7]
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 4), (4, 5), (5, 12))]
    stream, batch = staged(spark, parts, "session_id long, object_id long, snap_no long, shown boolean")
    got = M.object_state_stream(stream, fresh_dir(spark, "objects"), chunk=2)
    want = L.object_lifecycle(batch)
    cols = ["session_id", "newly_observed", "activations", "reused_activations", "hidden_transitions", "reuse_rate"]
    read = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert read(got) == read(want)


def test_error_feed_equals_batch(spark):
    rows = [(i, f"m{i % 3}", None, 1 + i % 2, 100 + i) for i in range(30)]
    stream, batch = staged(spark, [rows[:10], rows[10:]], "seq long, message string, stack string, counter int, time long")
    path = fresh_dir(spark, "feed")
    got = M.error_feed_stream(stream, path)
    read = lambda df: sorted((r.message, r.occurrences, r.first_time, r.last_time, r.latest_seq) for r in df.collect())
    assert read(got) == read(R.error_occurrences(batch))
    # Started again without new data, nothing is counted twice.
    assert read(M.error_feed_stream(stream, path)) == read(got)


ERROR = "seq long, message string, stack string, counter int, time long"


def folders(table, spark):
    import os

    live, covered = table.runs(spark)
    root = table.path.removeprefix("file:")
    return live, covered, {r: sorted(n for n in os.listdir(f"{root}/run={r[0]}_{r[1]}") if n.startswith("_bucket")) for r in live}


def test_a_batch_writes_what_it_brings_and_a_repeated_one_changes_nothing(spark):
    table = M.error_table(fresh_dir(spark, "log"), fan=3)
    many = spark.createDataFrame([(i, f"m{i}", "s", 1, 5) for i in range(200)], ERROR)
    one = spark.createDataFrame([(300, "m7", "s", 2, 9)], ERROR)
    total = lambda: {r.message: r.occurrences for r in table.current(spark).collect()}
    table.update(many, 0)
    table.update(one, 1)
    table.update(one, 1)
    assert len(folders(table, spark)[2][(1, 1)]) == 1 and len(folders(table, spark)[2][(0, 0)]) == 16
    assert total()["m7"] == 3 and sum(total().values()) == 202
    table.update(one, 2)
    assert folders(table, spark)[:2] == ([(0, 2)], [(0, 0), (1, 1), (2, 2)]) and total()["m7"] == 5
    table.update(one, 2)  # merged already
    assert total()["m7"] == 5 and folders(table, spark)[0] == [(0, 2)]
    for batch in range(3, 11):
        table.update(one, batch)
        assert total()["m7"] == 5 + 2 * (batch - 2) and sum(total().values()) == 204 + 2 * (batch - 2)
    assert folders(table, spark)[0] == [(0, 8), (9, 9), (10, 10)]


def test_a_writer_lost_while_merging_leaves_the_runs(spark):
    table = M.error_table(fresh_dir(spark, "log"), fan=2)
    one = spark.createDataFrame([(1, "m", "s", 2, 5)], ERROR)
    table.update(one, 0)
    write = table._write
    table._write = lambda rows, a, b: write(rows, a, b) if a == b else (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.update(one, 1)
    assert table.runs(spark) == ([(0, 0), (1, 1)], []) and table.current(spark).first().occurrences == 4
    table._write = write
    table.update(one, 1)  # the batch is run again
    assert table.runs(spark)[0] == [(0, 1)] and table.current(spark).first().occurrences == 4


@pytest.mark.parametrize("late, fan", [(3, 2), (64, 100)])
def test_object_state_of_rows_in_any_order(spark, late, fan):
    rng = random.Random(8)
    rows = [(s, o, n, rng.random() < 0.5) for s in (1, 2) for n in range(14) for o in range(6) if rng.random() < 0.7]
    parts, left = [], list(rows)
    while left:  # each part takes rows up to ``late`` snapshots behind the newest one
        low = min(r[2] for r in left)
        part = [r for r in left if r[2] <= low + late - 1 and (r[2] == low or rng.random() < 0.4)]
        left = [r for r in left if r not in part]
        parts.append(part + rng.sample(part, len(part) // 4))
    schema = "session_id long, object_id long, snap_no long, shown boolean"
    table = M.object_table(fresh_dir(spark, "objects"), late, chunk=4, fan=fan)
    for i, part in enumerate(parts):
        table.update(spark.createDataFrame(part, schema), i)
    cols = ["session_id", "newly_observed", "activations", "reused_activations", "hidden_transitions", "reuse_rate"]
    read = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert read(L.object_moves(table.current(spark))) == read(L.object_lifecycle(spark.createDataFrame(rows, schema)))
    if fan == 2:  # what is settled is one row per object
        held = table._read(spark, table.runs(spark)[0])
        assert held.where("closed").groupBy("session_id", "object_id").count().agg(F.max("count")).first()[0] == 1


SAMPLES = "session_id long, ts_us long, last_time double"
SECOND = 1_000_000
START = 1_700_000_000 * SECOND


def test_windows_and_sessions(spark):
    rows = [(1, t * SECOND // 4, float(t % 5)) for t in range(40)] + [(1, 30 * SECOND + t * SECOND // 4, 1.0) for t in range(8)]
    parts = [rows[:20], rows[20:], [(9, 200 * SECOND, 0.0)]]
    stream, batch = staged(spark, parts, SAMPLES)
    windows = S.run_to_table(C.sample_windows_stream(stream, delay="1 second"), "windows").filter("session_id = 1")
    want = batch.filter("session_id = 1").groupBy(F.expr("ts_us div 1000000 * 1000000").alias("start_us")).agg(F.count("*").alias("n"), F.sum("last_time").alias("total"))
    assert sorted((r.start_us, r.samples, r.total) for r in windows.collect()) == sorted(tuple(r) for r in want.collect())
    sessions = S.run_to_table(C.capture_session_stream(stream, "5 seconds", "1 second"), "sessions").filter("session_id = 1")
    assert sorted((r.started_us, r.ended_us, r.samples) for r in sessions.collect()) == [(0, 39 * SECOND // 4, 40), (30 * SECOND, 30 * SECOND + 7 * SECOND // 4, 8)]


def test_what_is_open_at_the_end_is_written(spark):
    rows = [(1, START + t * SECOND // 4, float(t % 5)) for t in range(40)]
    stream, batch = staged(spark, [rows[:25], rows[25:]], SAMPLES)
    live, end = S.closable(stream)
    windows = S.run_to_table(C.sample_windows_stream(live), "windows", end=end)
    assert sorted((r.session_id, r.samples) for r in windows.collect()) == [(1, 4)] * 10
    live, end = S.closable(stream)
    sessions = S.run_to_table(C.capture_session_stream(live), "sessions", end=end)
    assert [(r.session_id, r.samples) for r in sessions.collect()] == [(1, 40)]
    control = staged(spark, [[(1, START, "start", 60 * SECOND), (2, START, "start", None)]], "session_id long, ts_us long, action string, duration_us long")[0]
    live, end = S.closable(control, session_id=-1)
    done = S.run_to_table(C.capture_control_stream(live), "control", end=end).collect()
    assert sorted((r.session_id, (r.ended_us - START) // SECOND, r.reason) for r in done) == [(1, 60, "complete"), (2, 10, "complete")]


def test_moving_average(spark):
    rows = [(1, t * SECOND, float(t)) for t in range(10)] + [(9, 500 * SECOND, 0.0)]
    stream, _ = staged(spark, [rows], SAMPLES)
    got = S.run_to_table(C.sample_windows_stream(stream, "4 seconds", "1 second", "1 second"), "moving")
    assert {r.start_us // SECOND: r.average for r in got.filter("session_id = 1").collect()}[2] == (2 + 3 + 4 + 5) / 4


def test_capture_control(spark):
    def at(s, t, action, duration=None):
        return (s, START + t * SECOND, action, None if duration is None else duration * SECOND)

    parts = [
        [at(1, 0, "start", 100), at(1, 5, "start", 9), at(2, 0, "start"), at(3, 0, "start", 9999)],
        [at(1, 20, "manual"), at(1, 30, "combat"), at(1, 40, "start", 60), at(4, 50, "window_closed")],
        [at(1, 70, "combat"), at(9, 5000, "manual")],
    ]
    stream, _ = staged(spark, parts, "session_id long, ts_us long, action string, duration_us long")
    got = S.run_to_table(C.capture_control_stream(stream), "control").collect()
    assert sorted((r.session_id, r.capture_no, (r.started_us - START) // SECOND, (r.ended_us - START) // SECOND, r.reason) for r in got) == [
        (1, 1, 0, 20, "manual"), (1, 2, 40, 70, "combat"), (2, 1, 0, 10, "complete"), (3, 1, 0, 180, "complete"),
    ]


def test_late_repeats_are_dropped(spark):
    rows = [(i, START + i * SECOND) for i in range(20)]
    stream, _ = staged(spark, [rows[:10], rows[5:15], rows[12:]], "seq long, ts_us long")
    assert sorted(r.seq for r in S.run_to_table(C.late_data(stream, "1 minute"), "late").collect()) == list(range(20))


def test_live_capture_and_elapsed(spark):
    args = [("number", "1")]
    rows = [(1, 5 * SECOND, "A", args), (1, 7 * SECOND, "B", args), (1, 9 * SECOND, "a", args)]
    stream, _ = staged(spark, [rows[:1], rows[1:]], "session_id long, ts_us long, event string, args array<struct<type:string,text:string>>")
    starts = spark.createDataFrame([(1, 6 * SECOND)], "session_id long, started_us long")
    live = C.elapsed_stream(C.event_capture_stream(stream, ["A", "B"]), starts)
    got = S.run_to_table(live.select("event", "elapsed", "summary"), "live").collect()
    assert sorted((r.event, r.elapsed, r.summary) for r in got) == [("A", 0.0, "1"), ("B", 1.0, "1")]


def greedy(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t >= kept[-1] + gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("span", [1000, 1700, 10**9])
def test_thinning_equals_the_sequential_rule(spark, span):
    rng = random.Random(11)
    rows = [(1, i, rng.randrange(60000)) for i in range(900)] + [(2, i, 250 * i) for i in range(200)] + [(3, 0, 7), (4, 1, 0), (4, 2, 999), (4, 3, 1000), (4, 4, 5000)]
    df = spark.createDataFrame(rows, "session_id long, sample_id long, ts_us long").repartition(3)
    got = downsample_gap(df, 1000, span).collect()
    for session in (1, 2, 3, 4):
        want = greedy([r[2] for r in rows if r[0] == session], 1000)
        assert sorted(r.ts_us for r in got if r.session_id == session) == want


def test_sessions_that_share_a_state_stay_apart(spark):
    """Neighbouring sessions are kept by one state each 16 or 64: none sees the others' records, limits or numbers."""
    rows = [(s, s * 1000 + i, START + (i * 7919 % 101) * SECOND, f"E{i % 3}") for s in range(-20, 100) for i in range(1 + s % 9)]
    stream, batch = staged(spark, [rows[:200], rows[200:]], "session_id long, seq long, ts_us long, event string")
    got = C.ring_contents(S.run_to_table(C.ring_state_stream(stream, 4, 2), "ring"), 4)
    want = {}
    for s, seq, ts, _ in rows:
        want.setdefault(s, []).append((ts, seq))
    want = {(s, seq) for s, records in want.items() for _, seq in sorted(records, reverse=True)[:4]}
    assert {(r.session_id, r.seq) for r in got.collect()} == want
    starts = [(s, START + s * SECOND, "start", (5 + s % 50) * SECOND) for s in range(130)]
    stops = [(s, START + (s + 3) * SECOND, "manual", None) for s in range(0, 130, 10)]
    stream = staged(spark, [starts + stops], "session_id long, ts_us long, action string, duration_us long")[0]
    live, end = S.closable(stream, session_id=-1)
    done = {tuple(r) for r in S.run_to_table(C.capture_control_stream(live, 60), "control", end=end).collect()}
    assert done == {(s, 1, at, at + (3 if s % 10 == 0 else 5 + s % 50) * SECOND, "manual" if s % 10 == 0 else "complete") for s, at, _, _ in starts}
    assert C.RING_BLOCK > 1 and C.CONTROL_BLOCK > 1


def test_log_is_merged_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(S, "MERGE_ROWS", 10)
    table = M.object_table(fresh_dir(spark, "objects"))
    for batch in range(3):
        table.update(spark.createDataFrame([(1, o, batch, (o + batch) % 2 == 0) for o in range(40)], "session_id long, object_id long, snap_no long, shown boolean"), batch)
    held = table._read(spark, table.runs(spark)[0])
    assert held.count() == 120 and held.rdd.getNumPartitions() == 12
    assert sorted((r.object_id, r.activations, r.hidden) for r in table.current(spark).collect()) == [(o, 1, 1) for o in range(40)]
