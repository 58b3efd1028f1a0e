"""Greedy thinning: keep a sample only if it is far enough from the last kept one."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The partition functions run on executors that may not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


COLLECTED = 10_000  # rows gathered before an output batch is handed on


def _stretches(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of equal (session_id, _span) of a sorted partition as column arrays, one whole run at a time."""
    held: list[list[np.ndarray]] = []  # the pieces of the run that is still open
    key = None
    for rows in batches:
        if rows.empty:
            continue
        arrays = [rows[c].to_numpy() for c in ("session_id", "_span", *columns)]
        owner, span = arrays[:2]
        cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (span[1:] != span[:-1])) + 1).tolist(), len(owner)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (owner[a], span[a]) != key:
                yield tuple(np.concatenate(pieces) for pieces in zip(*held))
                held = []
            key = (owner[a], span[a])
            held.append([x[a:b] for x in arrays])
    if held:
        yield tuple(np.concatenate(pieces) for pieces in zip(*held))


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= COLLECTED:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _ends(times: np.ndarray, gap: int) -> list[int]:
    """For each sample: the last one kept in this stretch if that sample is kept."""
    following = np.searchsorted(times, times + gap).tolist()
    last = times.tolist()
    for i in range(len(last) - 1, -1, -1):
        if following[i] < len(last):
            last[i] = last[following[i]]
    return last


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def downsample_gap(samples: DataFrame, gap_us: int = 1_000_000, span_us: int = 600_000_000) -> DataFrame:
    """Samples kept per session: the first, then each first one at least ``gap_us`` after the last kept.

    Which samples a stretch of ``span_us`` keeps depends on the earlier ones only through
    the time of the last kept sample, and so only through which of the stretch's first
    samples is kept first. Stretches list the outcome for each such start in parallel; one
    small row per stretch is then walked in order, and the stretches are filled in parallel.
    """
    if span_us < gap_us:
        raise ValueError("a stretch must be at least as long as the gap")

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for owner, span, times in _stretches(batches, ["ts_us"]):
                starts = min(len(times), int(np.searchsorted(times, span[0] * span_us + gap_us)) + 1)
                yield owner[0], span[0], times[:starts], _ends(times, gap_us)[:starts]

        return _frames(rows(), ["session_id", "_span", "starts", "ends"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, kept = None, None
        for batch in batches:
            entries = []
            for owner, starts, ends in zip(batch["session_id"], batch["starts"], batch["ends"]):
                if owner != session:
                    session, kept = owner, None
                entries.append(-1 if kept is None else kept)
                at = 0 if kept is None else int(np.searchsorted(starts, kept + gap_us))
                if at < len(starts):
                    kept = int(ends[at])
            yield batch[["session_id", "_span"]].assign(_kept=entries)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for owner, _, times, ids, kept in _stretches(batches, ["ts_us", "sample_id", "_kept"]):
                following = np.searchsorted(times, times + gap_us).tolist()
                at = 0 if kept[0] < 0 else int(np.searchsorted(times, kept[0] + gap_us))
                while at < len(times):
                    yield owner[0], ids[at], times[at]
                    at = following[at]

        return _frames(rows(), ["session_id", "sample_id", "ts_us"])

    keys = ["session_id", "_span"]
    narrow = samples.select(
        "session_id", F.floor(F.col("ts_us") / span_us).cast("bigint").alias("_span"), "sample_id", "ts_us"
    )
    stretches = _sorted(narrow.select("session_id", "_span", "ts_us"), keys, ["ts_us"]).mapInPandas(
        outcomes, "session_id bigint, _span bigint, starts array<bigint>, ends array<bigint>"
    )
    entries = _sorted(stretches, ["session_id"], ["_span"]).mapInPandas(walk, "session_id bigint, _span bigint, _kept bigint")
    return _sorted(narrow.join(entries, keys), keys, ["ts_us", "sample_id"]).mapInPandas(
        keep, "session_id bigint, sample_id bigint, ts_us bigint"
    )
