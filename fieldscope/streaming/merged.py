"""Streams that keep a table of totals: object lifecycle, error occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.operators.errors import error_occurrences
from fieldscope.operators.lifecycle import CHUNK, object_moves
from fieldscope.plans import transition_totals
from fieldscope.plans.spread import portions
from fieldscope.streaming.runner import LogTable

OBJECT = ["session_id", "object_id"]
LATE = 64  # snapshots by which a row may come late


def observations(snapshots: DataFrame) -> DataFrame:
    """Each observation as a stretch of one snapshot; a repeated one counts once."""
    seen = portions(snapshots, *OBJECT).groupBy(*OBJECT, F.col("snap_no").alias("first_snap")).agg(F.max("shown").alias("born_shown"))
    zero = F.lit(0).cast("bigint")
    return seen.select(
        *OBJECT, zero.alias("activations"), zero.alias("hidden"), "born_shown", F.col("born_shown").alias("last_shown"),
        "first_snap", F.col("first_snap").alias("last_snap"), F.lit(False).alias("closed"),
    )


def whole_objects(stretches: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per object from its stretches: what happened inside them, and the steps from each to the next.

    An observation inside a closed stretch came too late to have a place and is passed over.
    """
    ends = stretches.where("closed").groupBy(*OBJECT).agg(F.max("last_snap").alias("_end"))
    placed = stretches.join(ends, OBJECT, "left").where("closed or _end is null or first_snap > _end")
    once = placed.groupBy(*OBJECT, "first_snap").agg(
        F.max_by(F.struct("activations", "hidden", "born_shown", "last_shown", "last_snap"), "last_snap").alias("s")
    ).select(*OBJECT, "first_snap", "s.*")
    steps = transition_totals(
        once, OBJECT, ["first_snap"], F.floor(F.col("first_snap") / chunk), ["born_shown", "last_shown", "last_snap"],
        {
            "on": lambda was, now: (now["born_shown"] & ~was["last_shown"]).cast("bigint"),
            "off": lambda was, now: (~now["born_shown"] & was["last_shown"]).cast("bigint"),
        },
    )
    inside = once.groupBy(*OBJECT).agg(F.sum("activations").alias("activations"), F.sum("hidden").alias("hidden"))
    return steps.join(inside, OBJECT).select(
        *OBJECT,
        (F.col("activations") + F.col("on")).alias("activations"),
        (F.col("hidden") + F.col("off")).alias("hidden"),
        F.col("first.born_shown").alias("born_shown"),
        F.col("last.last_shown").alias("last_shown"),
        F.col("first.first_snap").alias("first_snap"),
        F.col("last.last_snap").alias("last_snap"),
    )


def closed_stretches(stretches: DataFrame, late: int = LATE, chunk: int = CHUNK) -> DataFrame:
    """Stretches that no row can come between any more become one per object; later observations stay as they are.

    Only for all there is from the beginning on: what comes between stretches must be among them.
    """
    newest = stretches.groupBy("session_id").agg((F.max("last_snap") - late).alias("_limit"))
    known = stretches.join(newest, "session_id").withColumn("_settled", F.col("closed") | (F.col("last_snap") <= F.col("_limit"))).drop("_limit")
    settled = whole_objects(known.where("_settled").drop("_settled"), chunk).withColumn("closed", F.lit(True))
    return settled.unionByName(known.where("not _settled").drop("_settled").dropDuplicates([*OBJECT, "first_snap"]))


def object_table(path: str, late: int = LATE, chunk: int = CHUNK, **layout) -> LogTable:
    once = lambda rows: rows.dropDuplicates([*OBJECT, "first_snap"])
    return LogTable(path, OBJECT, observations, once, lambda rows: closed_stretches(rows, late, chunk), lambda rows: whole_objects(rows, chunk), **layout)


def object_state_stream(snapshots: DataFrame, path: str, chunk: int = CHUNK, late: int = LATE, **trigger) -> DataFrame:
    """Lifecycle counters per session, kept up with arriving snapshots.

    Observations may arrive in any order within ``late`` snapshots of their session's newest one, in one
    micro-batch or over many; one that repeats counts once. Each micro-batch writes its own rows only; merging
    closes what can no longer change, so an object keeps its last ``late`` observations and one row for all before.
    """
    table = object_table(path, late, chunk)
    table.follow(snapshots, **trigger)
    return object_moves(table.current(snapshots.sparkSession))


def merge_errors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signature", "message", "stack").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("latest_seq").alias("latest_seq"),
    )


def error_table(path: str, **layout) -> LogTable:
    return LogTable(path, ["signature"], error_occurrences, merge_errors, **layout)


def error_feed_stream(errors: DataFrame, path: str, **trigger) -> DataFrame:
    """Occurrences per error signature; the trigger interval bounds how often the table changes."""
    table = error_table(path)
    table.follow(errors, **trigger)
    return table.current(errors.sparkSession)
