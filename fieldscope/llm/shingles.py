"""Five-word shingles of whole texts as DataFrame expressions, shared by the searches for known passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm import blocks
from fieldscope.session import pin

WORDS = 5
SMALL = 1_000_000  # rows of a few dozen bytes that may go to every task


def words_of(text: str) -> Column:
    """Runs of letters and digits, in lower case. Null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, text): row_key names the row by id and text."""
    return docs.select(
        blocks.row_key(doc_id, text).alias("row_key"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


def places(words: str = "words") -> Column:
    """The numbers of the words at which a shingle starts; none for fewer words than a shingle has."""
    last = F.size(words) - WORDS
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def hash_at(place: Column, words: str = "words") -> Column:
    return F.xxhash64(*[F.get(F.col(words), place + k) for k in range(WORDS)])


def text_at(place: Column, words: Column) -> Column:
    return F.array_join(F.slice(words, place + 1, WORDS), " ")


def once(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once: an expression that a lambda refers to is else worked out in each step."""
    return F.transform(F.array(value), use)[0]


def texts_in(words: Column) -> Column:
    """All shingles of an array of words, repeats included."""

    def cut(held):
        last = F.size(held) - WORDS
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: text_at(i, held))).otherwise(F.array().cast("array<string>"))

    return once(words, cut)


def windows_of(rows: DataFrame, asked: DataFrame, first: Column, length: Column, n_rows: int | None = None) -> DataFrame:
    """A row per row of ``asked`` (row_key, ...) with ``texts``: the shingles of its window of the row's words.

    The windows of a row come to its text together, so that the text is split once; they are cut from its words one by one.
    If they are too many to go to every task, the rows that have any are found by the hash of their key, and only those are shuffled.
    """
    wanted = [c for c in asked.columns if c != "row_key"]
    gathered = asked.groupBy("row_key").agg(F.collect_list(F.struct(*wanted)).alias("_asked"))
    held = pin(gathered, "asked-windows", n_rows)
    if total(held, F.size("_asked")) <= SMALL:
        joined = rows.join(F.broadcast(held), "row_key")
    else:
        keys = sendable(held.select(F.xxhash64("row_key").alias("_key")).distinct(), "asked-keys", rows=n_rows)
        joined = rows.join(keys, F.xxhash64("row_key") == F.col("_key"), "left_semi").join(held, "row_key")
    split = joined.select("row_key", "doc_id", words_of("text").alias("_words"), "_asked")
    windows = split.select("row_key", "doc_id", "_words", F.explode("_asked").alias("_w")).select("row_key", "doc_id", "_words", "_w.*")
    return windows.select("row_key", "doc_id", *wanted, texts_in(F.slice("_words", first + 1, length)).alias("texts"))


def total(table: DataFrame, weight: Column) -> int:
    """What the rows of a table with lists count as: the sum of the lengths of their lists."""
    return table.agg(F.sum(weight.cast("long"))).first()[0] or 0


def sendable(table: DataFrame, label: str, most: int = SMALL, *, rows: int | None = None) -> DataFrame:
    """The table, written once (by few tasks, if it has only about ``rows`` rows); marked for broadcast if it has no more
    than ``most`` rows, else left to a shuffled join."""
    held = pin(table, label, rows)
    return F.broadcast(held) if held.count() <= most else held


def hits(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (shingle, ...) joined to each place of ``rows`` where the shingle stands: row_key, n_words, place and its columns.

    Shingles are hashed while the places are walked through; rows are made only for those that are wanted. Large ``wanted``
    tables are joined by the hash alone.
    """
    split = rows.select("row_key", words_of("text").alias("words"))
    walked = split.select("row_key", "words", F.explode(places()).alias("place"))
    hashed = walked.select("row_key", F.size("words").alias("n_words"), "place", hash_at(F.col("place")).alias("shingle"))
    return hashed.join(wanted, "shingle")
