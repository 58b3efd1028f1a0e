"""Event and call records: selection, formatting, newest records, catalog."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.functions import wording
from fieldscope.functions.numbers import fixed
from fieldscope.plans import top_per_key


class SelectionError(ValueError):
    """The requested event selection is empty, malformed or not offered by the source."""


def event_select(records: DataFrame, names: Sequence[str], available: DataFrame | None = None) -> DataFrame:
    """Keep the selected events; ``ALL`` keeps everything.

    ``available`` (column ``event``) lists what the source offers; one name outside it
    rejects the whole request.
    """
    unique = list(dict.fromkeys(names))
    if not unique:
        raise SelectionError("select at least one event")
    for name in unique:
        if not isinstance(name, str) or not re.fullmatch(T.EVENT_NAME, name):
            raise SelectionError(f"invalid event: {name}")
    if "ALL" in unique:
        return records
    if available is not None:
        offered = available.filter(F.col("event").isin(unique)).select("event").distinct().collect()
        missing = sorted(set(unique) - {row.event for row in offered})
        if missing:
            raise SelectionError(f"unavailable event: {missing[0]}")
    return records.filter(F.col("event").isin(unique))


def split_event_names(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a well-formed event name, and the rejects."""
    ok = T.valid_event_name(F.col("event"))
    return records.filter(ok), records.filter(~ok)


def trace_filter(calls: DataFrame, path: str) -> DataFrame:
    """Calls of the traced function path."""
    return calls.filter(F.col("path") == path.strip())


def formatted(records: DataFrame, limit: int = wording.EVENT_ARGUMENT_BYTES, most: int = 16) -> DataFrame:
    """Add the argument texts and their one-line summary."""
    return records.withColumn("arguments", T.format_arguments(F.col("args"), most, limit)).withColumn(
        "summary", F.array_join("arguments", ", ")
    )


def elapsed_since_start(records: DataFrame, key: str = "session_id") -> DataFrame:
    """Seconds since the first record of the session, never below 0."""
    starts = records.groupBy(key).agg(F.min("ts_us").alias("_start"))
    return (
        records.join(starts, key)
        .withColumn("elapsed", F.greatest(F.lit(0.0), (F.col("ts_us") - F.col("_start")) / 1e6))
        .drop("_start")
    )


def newest_records(records: DataFrame, limit: int, key: str = "session_id") -> DataFrame:
    order = [F.col("ts_us").desc(), F.col("seq").desc()]
    return top_per_key(records, [key], order, limit)


def latest_events(records: DataFrame, limit: int = 500, key: str = "session_id") -> DataFrame:
    return newest_records(records, limit, key)


def latest_calls(calls: DataFrame, limit: int = 300, key: str = "session_id") -> DataFrame:
    return newest_records(calls, limit, key)


def event_detail(name: Column, elapsed: Column, arguments: Column) -> Column:
    return _detail(wording.EVENT_DETAIL, wording.NO_PAYLOAD, name, elapsed, arguments)


def call_detail(path: Column, elapsed: Column, arguments: Column) -> Column:
    return _detail(wording.CALL_DETAIL, wording.NO_ARGUMENTS, path, elapsed, arguments)


def _detail(title: str, empty: str, name: Column, elapsed: Column, arguments: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.format_string(title, name),
        F.format_string(wording.ELAPSED_DETAIL, fixed(elapsed, 3)),
        F.lit(""),
        T.argument_lines(arguments, empty),
    )


def event_signature(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Signature of (build, event_name); ``ALL`` is ``*``, unknown names have none."""
    signature = F.when(F.col("event_name") == "ALL", "*").otherwise(F.col("signature"))
    return names.join(catalog, ["build", "event_name"], "left").withColumn("signature", signature)


def catalog_search(catalog: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Names of one build's catalog: exact, then prefix, then inner matches, each by name."""
    needle = query.strip().upper()
    needle = "ALL" if needle in ("全部", "全部事件") else needle
    if not needle:
        return catalog.select("event_name", "signature").withColumn("match", F.lit(0)).limit(0)
    at = F.instr(F.col("event_name"), needle)
    match = F.when(F.col("event_name") == needle, 1).when(at == 1, 2).when(at > 1, 3)
    hits = catalog.select("event_name", "signature", match.alias("match")).filter(F.col("match").isNotNull())
    if needle == "ALL":
        everything = catalog.sparkSession.createDataFrame([("ALL", "*", 1)], "event_name string, signature string, match int")
        hits = everything.unionByName(hits)
    return hits.orderBy("match", "event_name").limit(max(1, int(limit)))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("build").agg(F.count(F.lit(1)).alias("events"))


def catalog_compare(catalog: DataFrame, left: int, right: int) -> DataFrame:
    """Events of two builds: common or only in one, and whether signatures differ."""
    pick = lambda build: F.max(F.when(F.col("build") == build, F.col("signature")))
    sides = (
        catalog.filter(F.col("build").isin(left, right))
        .groupBy("event_name")
        .agg(pick(left).alias("_l"), pick(right).alias("_r"))
    )
    return sides.select(
        "event_name",
        F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").otherwise("common").alias("presence"),
        F.coalesce(F.col("_l") != F.col("_r"), F.lit(False)).alias("signature_differs"),
    )


def distinct_first(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return rows.groupBy(*keys).agg(F.min(position).alias("first_position"))
