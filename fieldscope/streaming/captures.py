"""Live event capture, newest records, sample windows, capture sessions, late data."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldscope.functions.numbers import exact_sum
from fieldscope.operators.events import event_select, formatted
from fieldscope.plans import top_per_key
from fieldscope.streaming.runner import event_time, use_rocksdb

# The processors run on executors that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_capture_stream(records: DataFrame, names: Sequence[str], available: DataFrame | None = None) -> DataFrame:
    """Selected events with formatted arguments, as they arrive."""
    return formatted(event_select(records, names, available)).drop("args")


def elapsed_stream(records: DataFrame, captures: DataFrame) -> DataFrame:
    """Add seconds since the start of the capture (``session_id``, ``started_us``)."""
    started = records.join(captures, "session_id")
    return started.withColumn("elapsed", F.greatest(F.lit(0.0), (F.col("ts_us") - F.col("started_us")) / 1e6))


RING_COLUMNS = ["ts_us", "seq", "event"]
STEP = 4096  # records put in order at once
RING_BLOCK, CONTROL_BLOCK = 16, 64  # sessions of a state
RING_OUT = "session_id bigint, shard int, ts_us bigint, seq bigint, event string"


def block(size: int) -> Column:
    """Sessions that share a state: at most ``size`` numbers that follow each other. A state is read and written by a call to the JVM each."""
    return F.floor(F.col("session_id") / size)


class NewestRecords(StatefulProcessor):
    """Keeps the newest records of each session of a (block, shard) and reports those that are new among them, each once."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("kept", "session_id bigint, ts_us bigint, seq bigint, event string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = {}
        for session, *record in self.state.get():
            kept.setdefault(session, []).append(tuple(record))
        known = {(session, record[1]) for session, records in kept.items() for record in records}
        while part := list(islice(rows, STEP)):
            arrived = {}
            for r in part:
                arrived.setdefault(r.session_id, []).append((r.ts_us, r.seq, r.event))
            for session, records in arrived.items():
                once = {}
                for record in sorted([*kept.get(session, ()), *records], key=lambda r: r[:2], reverse=True):
                    once.setdefault(record[1], record)
                kept[session] = list(islice(once.values(), self.limit))
        entered = [(session, record) for session, records in kept.items() for record in records if (session, record[1]) not in known]
        if entered:
            self.state.put([(session, *record) for session, records in kept.items() for record in records])
        for session, (ts_us, seq, event) in entered:
            yield Row(session_id=session, shard=key[1], ts_us=ts_us, seq=seq, event=event)

    def close(self) -> None:
        pass


def ring_state_stream(records: DataFrame, limit: int = 500, shards: int = 16) -> DataFrame:
    """The newest ``limit`` records per session as bounded state.

    A busy session is spread over shards that keep ``limit`` each; ``ring_contents`` reads
    the session's newest out of them. Sessions of neighbouring numbers share a state.
    """
    use_rocksdb(records.sparkSession)
    keyed = records.select("session_id", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), *RING_COLUMNS)
    return keyed.withColumn("_block", block(RING_BLOCK)).groupBy("_block", "shard").transformWithState(
        statefulProcessor=NewestRecords(limit), outputStructType=RING_OUT, outputMode="Append", timeMode="None"
    )


def ring_contents(entered: DataFrame, limit: int = 500) -> DataFrame:
    """Current content from the records that entered the ring: what is in it has entered, and is the newest of that."""
    return top_per_key(entered.drop("shard"), ["session_id"], [F.col("ts_us").desc(), F.col("seq").desc()], limit)


def sample_windows_stream(
    samples: DataFrame, every: str = "1 second", slide: str | None = None, delay: str = "10 seconds"
) -> DataFrame:
    """Sample count, total and peak per session and window; with ``slide`` a moving average."""
    window = F.window("event_time", every, slide) if slide else F.window("event_time", every)
    return (
        event_time(samples, delay=delay)
        .groupBy("session_id", window.alias("w"))
        .agg(
            F.count("last_time").alias("samples"),
            exact_sum(F.col("last_time")).alias("total"),
            F.max("last_time").alias("peak"),
        )
        .select(
            "session_id",
            F.unix_micros("w.start").alias("start_us"),
            "samples",
            "total",
            "peak",
            F.when(F.col("samples") > 0, F.col("total") / F.col("samples")).alias("average"),
        )
    )


def capture_session_stream(samples: DataFrame, gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Implicit captures: samples of a session no further apart than ``gap``.

    Sessions are merged inside each input task first, so a busy one is not shuffled sample by sample.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        event_time(samples, delay=delay)
        .groupBy("session_id", F.session_window("event_time", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            exact_sum(F.col("last_time")).alias("total"),
            F.min("ts_us").alias("started_us"),
            F.max("ts_us").alias("ended_us"),
        )
        .select("session_id", "samples", "total", "started_us", "ended_us")
    )


CONTROL_OUT = "session_id bigint, capture_no bigint, started_us bigint, ended_us bigint, reason string"


class CaptureControl(StatefulProcessor):
    """Explicit captures of the sessions of a block: start, stop with a reason, or the time limit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("sessions", "session_id bigint, capture_no bigint, started_us bigint, limit_us bigint")

    def _read(self) -> dict:
        return {session: (number, started, limit) for session, number, started, limit in self.state.get()}

    def _write(self, sessions: dict) -> None:
        self.state.put([(session, *held) for session, held in sessions.items()])
        limits = [limit for _, _, limit in sessions.values() if limit is not None]
        if limits:  # a block has a timer for the first of its limits
            self.handle.registerTimer(min(limits) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sessions, changed = self._read(), False
        control = [(r.ts_us, r.session_id, r.action, r.duration_us) for r in rows if r.action is not None]
        for at_us, session, action, duration in sorted(control, key=lambda r: r[0]):
            number, started, limit = before = sessions.get(session, (0, None, None))
            if started is not None and at_us >= limit:
                yield self._end(session, number, started, limit, "complete")
                started = limit = None
            if action == "start" and started is None:
                number, started, limit = number + 1, at_us, at_us + duration
            elif action != "start" and started is not None:
                yield self._end(session, number, started, at_us, action)
                started = limit = None
            if (number, started, limit) != before:
                sessions[session], changed = (number, started, limit), True
        if changed:
            self._write(sessions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions, upto = self._read(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = [(session, held) for session, held in sessions.items() if held[2] is not None and held[2] // 1000 <= upto]
        for session, (number, started, limit) in over:
            sessions[session] = (number, None, None)
            yield self._end(session, number, started, limit, "complete")
        if sessions:
            self._write(sessions)

    @staticmethod
    def _end(session: int, number: int, started: int, at_us: int, reason: str) -> Row:
        return Row(session_id=session, capture_no=number, started_us=started, ended_us=at_us, reason=reason)

    def close(self) -> None:
        pass


def capture_control_stream(control: DataFrame, longest_seconds: int = 180, delay: str = "10 seconds") -> DataFrame:
    """Finished captures from control events (``session_id``, ``ts_us``, ``action``, ``duration_us``).

    ``action`` is start, or the reason of a stop: manual, combat, window_closed. Only control
    events pass through the state; samples belong to a capture by its times.
    """
    use_rocksdb(control.sparkSession)
    capped = control.withColumn(
        "duration_us", F.least(F.coalesce("duration_us", F.lit(10_000_000)), F.lit(longest_seconds * 1_000_000)).cast("bigint")
    )
    return (
        event_time(capped, delay=delay)
        .withColumn("_block", block(CONTROL_BLOCK))
        .groupBy("_block")
        .transformWithState(
            statefulProcessor=CaptureControl(), outputStructType=CONTROL_OUT, outputMode="Append", timeMode="EventTime"
        )
    )


def late_data(records: DataFrame, delay: str = "1 hour", key: str = "seq") -> DataFrame:
    """Records once each: repeats that arrive within the watermark are dropped."""
    return event_time(records, delay=delay).dropDuplicatesWithinWatermark([key]).drop("event_time")
