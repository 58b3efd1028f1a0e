"""Captured errors: scope, search, source, report, occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions import text as T
from fieldscope.functions import wording as W


def safe_text(value: Column) -> Column:
    """Empty for null, cut like every text that a report shows."""
    return T.byte_truncate(F.coalesce(value, F.lit("")), W.REPORT_BYTES, W.CUT_TEXT)


def errors_scan(errors: DataFrame) -> DataFrame:
    """Newest inserted first."""
    return errors.orderBy(F.col("seq").desc())


def session_number(session: Column) -> Column:
    return session.try_cast("bigint")


def errors_scope(errors: DataFrame, scope: str, current: int) -> DataFrame:
    """``all`` keeps everything; any other scope keeps the current session."""
    if scope == "all":
        return errors
    return errors.filter(session_number(F.col("session")) == current)


def errors_search(errors: DataFrame, text: str) -> DataFrame:
    """Literal match in any case over the whole message, stack and source; empty matches all."""
    needle = text.strip().lower()
    if not needle:
        return errors
    searched = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("message", "stack", "source")]))
    return errors.filter(F.contains(searched, F.lit(needle)))


def error_source() -> Column:
    return T.error_source(F.col("source"), F.col("message"), F.col("stack"))


def error_occurrences(errors: DataFrame) -> DataFrame:
    """Occurrences per signature (whole message and stack); a missing counter is 1."""
    whole = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        errors.groupBy(whole("message"), whole("stack"))
        .agg(
            F.sum(F.coalesce("counter", F.lit(1))).alias("occurrences"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
            F.max("seq").alias("latest_seq"),
        )
        .withColumn("signature", F.sha2(F.concat("message", F.lit("\n"), "stack"), 256))
    )


def error_report(version: str, build: str, build_date: str, locale: str) -> Column:
    """The text report of one error row."""
    line = lambda pattern, *cols: F.format_string(pattern, *cols)
    stack = safe_text(F.col("stack"))
    has_locals = safe_text(F.col("locals")) != ""
    time = F.when(F.col("time").isNull(), W.UNKNOWN_TIME).otherwise(T.format_time(F.col("time")))
    return F.concat_ws(
        "\n",
        F.lit(W.ERROR_TITLE),
        F.lit(""),
        F.lit(W.ERROR_CONTEXT),
        line(W.ERROR_TIME, time),
        line(W.ERROR_SOURCE, error_source()),
        line(W.ERROR_COUNT, F.coalesce("counter", F.lit(1))),
        line(W.ERROR_SESSION, F.coalesce(session_number(F.col("session")), F.lit(-1))),
        F.lit(""),
        F.lit(W.ERROR_ENVIRONMENT),
        line(W.ERROR_VERSION, F.lit(version)),
        line(W.ERROR_BUILD, F.lit(build), F.lit(build_date)),
        line(W.ERROR_LOCALE, F.lit(locale)),
        F.lit(""),
        F.lit(W.ERROR_ERROR),
        safe_text(F.col("message")),
        F.lit(""),
        F.lit(W.ERROR_STACK),
        F.when(stack == "", W.NOT_AVAILABLE).otherwise(stack),
        F.when(has_locals, F.lit("")),
        F.when(has_locals, F.lit(W.ERROR_LOCALS)),
        F.when(has_locals, safe_text(F.col("locals"))),
    )
