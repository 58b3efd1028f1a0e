"""Quality rules whose cutoffs are chosen so that few good documents are rejected.

Method: labelled holdout documents are counted by signal value; for each stratum and rule an exact binomial bound
certifies the cutoffs whose false rejection stays below a limit. The limit is split over the rules, the error
probability over all tests of rules and strata (Bonferroni); the cutoffs of one rule are tested from the most lenient
on, and the first failure ends them (a fixed sequence needs no further split). All certified cutoffs hold at once, so
the one of most use may be picked: that which rejects the most bad documents, less PRICE times the good ones.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.llm import arrays, blocks
from fieldscope.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"

#: rule -> (value, bins per unit, highest bin). A document is rejected when its bin reaches the rule's cutoff.
RULES: dict[str, tuple[str, float, int]] = {
    "symbols_per_word": ("n_symbols / n_words", 100, 400),
    "duplicate_lines": ("n_dup_lines / n_lines", 100, 100),
    "repeated_words": ("n_repeat_words / n_words", 200, 200),
    "word_length": ("word_chars / n_words", 10, 400),
}

FALSE_REJECTION = 0.02  # share of good documents of a stratum that all rules together may reject
ERROR = 0.05  # probability that any certified cutoff is wrong
PRICE = 10  # shares of the bad documents that a share of the good ones is worth
SMALL_TABLE = 10_000  # strata whose cutoffs may be broadcast: a few hundred bytes each


def _per_doc(marks: np.ndarray, borders: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[borders[1:]] - sums[borders[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    again, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = same[:-1]
    again[order] = same[:-1] | same[1:]
    return again, later


def _of_doc(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return arrays.mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """The SIGNALS of each document of a batch."""
    starts, ends, first_word = arrays.word_spans(data, offsets)
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    lead &= (data != 32) & ((data < 9) | (data > 13))
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))

    breaks = np.flatnonzero(data == 10)
    heads = np.union1d(offsets[:-1], breaks + 1)
    heads = heads[heads < len(data)]
    tails = np.append(heads[1:], len(data))
    tails = tails - (data[tails - 1] == 10) if len(heads) else tails
    worded = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    heads, tails = heads[worded], tails[worded]
    line_owner = np.searchsorted(offsets, heads, side="right") - 1
    lines = np.empty(len(heads), np.uint64)
    at = 0
    while at < len(heads):
        upto = max(at + 1, int(np.searchsorted(heads, heads[at] + arrays.PIECE)))
        low, high = heads[at], tails[upto - 1]
        lines[at:upto] = arrays.span_hashes(arrays._table(7)[data[low:high]], heads[at:upto] - low, tails[at:upto] - low, 7)
        at = upto
    _, later = _repeats(_of_doc(lines, line_owner))

    begins = arrays.window_starts(first_word, window)
    grams = arrays.span_hashes(arrays.word_hashes(data, starts, ends), begins, begins + window, 9)
    owner = np.searchsorted(first_word, begins, side="right") - 1
    again, _ = _repeats(_of_doc(grams, owner))
    repeated = arrays.covered(begins[again], begins[again] + window, len(starts))
    return [
        np.diff(first_word),
        _per_doc(lead, offsets),
        _per_doc(symbol, offsets),
        np.bincount(line_owner[later], minlength=n),
        _per_doc(repeated, first_word),
        np.bincount(line_owner, minlength=n),
    ]


def signals(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all unless given) and a struct ``signals``: counts over the whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier
    line), n_repeat_words (words in 5-word windows that occur twice or more), n_lines (lines with a word).
    Null text counts as empty. An input column named ``signals`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "signals"]
    passed = [F.col(f"`{c}`") for c in names]
    if text in names and docs.schema[text].dataType == T.StringType():
        measured = names.index(text)  # sent once
    else:
        measured = len(names)
        passed.append(F.col(f"`{text}`").cast("string").alias(blocks.spare("_measured", names)))
    source = docs.select(*passed)
    kinds = T.StructType([T.StructField(s, T.LongType()) for s in SIGNALS])
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("signals", kinds)])

    def counted(batches):
        for batch in batches:
            data, offsets = arrays.text_bytes(batch.column(measured))
            parts = []
            for a, b in arrays.doc_slices(offsets):
                parts.append(measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            values = [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in zip(*parts)] if parts else [pa.array([], pa.int64())] * len(SIGNALS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.StructArray.from_arrays(values, SIGNALS)], [*names, "signals"])

    return source.mapInArrow(counted, schema)


def base_failed(signals: str = "signals") -> Column:
    s = F.col(signals)
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def _bins(signals: str = "signals") -> dict[str, Column]:
    """Each rule's bin; a value without denominator is in the lowest."""
    out = {}
    for rule, (value, per_unit, highest) in RULES.items():
        over, under = (F.col(f"{signals}.{name}") for name in value.split(" / "))
        share = F.when(under > 0, over * int(per_unit) / under).otherwise(0)
        out[rule] = F.least(F.floor(share), F.lit(highest)).cast("int")
    return out


def binomial_tail(k: int, n: int, share: float) -> float:
    """P(X <= k) of a binomial X, exact to rounding; 1 where k is at or above the mean."""
    if k >= n * share:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    term = total = 1.0
    for i in range(k, 0, -1):  # from the largest term down
        term *= i * (1 - share) / ((n - i + 1) * share)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log) * total)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", risk: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """The cutoffs: a row per stratum with a column per rule (null: none is certified, or none of use).

    ``measured`` has signals, the stratum and the id; ``labels`` has doc_id and quality, of which 1 means good and all else
    bad. A document with several labels is good if all say so; null labels and ids don't count. Only documents that
    the base rule keeps are counted. Null is a stratum of its own.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("_good"))
    held = (
        measured.where(~base_failed())
        .select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{stratum}`").cast("string").alias("_stratum"), "signals")
        .join(marks, "_id")
    )
    rows = held.select("_stratum", "_good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), b.alias("bin")) for r, b in _bins().items()])).alias("x"))
    bins = sum(highest + 1 for _, _, highest in RULES.values())  # of a stratum
    counts = pin(rows.groupBy("_stratum", "x.rule", "x.bin").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")), "holdout-counts", bins)
    strata = max(1, counts.select("_stratum").distinct().count())
    of_rule = Window.partitionBy("_stratum", "rule")
    down = of_rule.orderBy(F.desc("bin"))  # a table of strata x rules x bins, however many documents there are
    tests = counts
    for kind in ("good", "bad"):
        tests = tests.withColumn(f"k_{kind}", F.sum(kind).over(down)).withColumn(f"of_{kind}", F.sum(kind).over(of_rule))

    share = risk / len(RULES)

    @F.pandas_udf("double")
    def tail(k: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), share) for a, b in zip(k, of)], dtype="float64")

    level = error / len(RULES) / strata
    share_of = lambda kind: F.when(F.col(f"of_{kind}") > 0, F.col(f"k_{kind}") / F.col(f"of_{kind}")).otherwise(0.0)
    tests = tests.withColumn("p", tail("k_good", "of_good")).withColumn("gain", share_of("bad") - PRICE * share_of("good"))
    best = F.max(F.when((F.col("p") <= level) & (F.col("gain") > 0), F.struct("gain", "bin")))["bin"]
    chosen = tests.groupBy("_stratum").pivot("rule", list(RULES)).agg(best)
    return pin(chosen, "cutoffs", strata)


def judged(measured: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept: false if the base rule fails, or a rule's bin reaches the cutoff of the stratum."""
    group, *cuts = [blocks.spare(c, measured.columns) for c in ("_stratum", *[f"_cut_{r}" for r in RULES])]
    limits = limits.select(F.col("_stratum").alias(group), *[F.col(r).alias(c) for r, c in zip(RULES, cuts)])
    if limits.count() <= SMALL_TABLE:
        limits = F.broadcast(limits)
    rows = measured.join(limits, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col(group)), "left")
    within = F.lit(True)
    for (_, bin_), cut in zip(_bins().items(), cuts, strict=True):
        within &= F.coalesce(bin_ < F.col(cut), F.lit(True))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)
    return rows.drop(group, *cuts)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its signals, base_failed and kept.

    Null or empty text has no words and fails the base rule. Repeated rows are judged alike. An empty
    table, or one without labels, has no certified cutoffs: the base rule alone decides. Columns
    named signals, base_failed or kept are replaced. Texts are read twice and never shuffled.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{stratum}`").alias("_group"), F.col(f"`{text}`").alias("_text"))
    limits = cutoffs(signals(narrow, "_text", ["_doc", "_group"]), labels, "_group", "_doc")
    return judged(signals(docs, text), limits, stratum)
