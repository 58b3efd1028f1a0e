"""Shares, risk rules and number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve profiler metrics of a counter set.
METRICS = [
    "session_average",
    "recent_average",
    "encounter_average",
    "last_time",
    "peak_time",
    "over1",
    "over5",
    "over10",
    "over50",
    "over100",
    "over500",
    "over1000",
]


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on row order.

    Each value is added as a decimal of its own size: below 1e-4 with 24 digits after the point, from 1e15 on as a
    whole number, in between with 12 digits; nothing down to 1e-24 is lost.
    """
    size = F.abs(value)
    parts = (
        (size < 1e-4, "decimal(28,24)"),
        ((size >= 1e-4) & (size < 1e15), "decimal(28,12)"),
        (size >= 1e15, "decimal(38,0)"),
    )
    sums = [F.sum(F.when(inside, value).cast(kind)).cast("double") for inside, kind in parts]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sums[1:]), F.coalesce(sums[0], F.lit(0.0)))
    return F.when(F.count(value) > 0, total)


def relative_share(addon: Column, overall: Column, application: Column) -> Column:
    """Percent of one addon within the application without the other addons."""
    base = application - overall + addon
    return F.when(base > 0, F.greatest(F.lit(0.0), addon / base * 100))


def overall_share(overall: Column, application: Column) -> Column:
    """Percent of all addons within the application."""
    return F.when(application > 0, F.greatest(F.lit(0.0), overall / application * 100))


def delta(final: Column, initial: Column) -> Column:
    """``final - initial``, null unless both are known."""
    return final - initial


def risk_label(severity: Column) -> Column:
    return (
        F.when(severity >= 4, "critical")
        .when(severity >= 3, "high")
        .when(severity >= 2, "watch")
        .when(severity >= 1, "history")
        .otherwise("none")
    )


def fixed(value: Column, digits: int) -> Column:
    """The double's exact value rounded half to even, as C's ``%.Nf`` prints it."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def format_ms(value: Column) -> Column:
    return (
        F.when(value.isNull(), "--")
        .when((value >= 0) & (value < 0.001), "below 0.001 ms")
        .when(value < 0.1, F.concat(fixed(value, 3), F.lit("ms")))
        .when(value < 10, F.concat(fixed(value, 2), F.lit("ms")))
        .otherwise(F.concat(fixed(value, 1), F.lit("ms")))
    )


def format_percent(value: Column) -> Column:
    return (
        F.when(value.isNull(), "--")
        .when((value > 0) & (value < 0.01), "<0.01%")
        .when(value < 0.1, F.concat(fixed(value, 2), F.lit("%")))
        .when(value < 10, F.concat(fixed(value, 1), F.lit("%")))
        .otherwise(F.concat(fixed(value, 0), F.lit("%")))
    )


def _sign(value: Column) -> Column:
    return F.when(value > 0, "+").when(value < 0, "-").otherwise("")


def format_bytes(value: Column, signed: bool = False) -> Column:
    """``12 B`` / ``1.5 KB`` / ``2.25 MB``; the signed form is for deltas."""
    size = F.abs(value.cast("double"))
    text = (
        F.when(size >= 1048576, F.concat(fixed(size / 1048576, 2), F.lit(" MB")))
        .when(size >= 1024, F.concat(fixed(size / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.floor(size + 0.5).cast("string"), F.lit(" B")))
    )
    body = F.concat(_sign(value), text) if signed else text
    return F.when(value.isNull(), "--").otherwise(body)


def format_memory(kilobytes: Column, signed: bool = False) -> Column:
    """Kilobytes as ``12 KB`` / ``1.5 MB``."""
    size = F.abs(kilobytes) if signed else kilobytes
    text = F.when(size >= 1024, F.concat(fixed(size / 1024, 1), F.lit(" MB"))).otherwise(
        F.concat(fixed(size, 0), F.lit(" KB"))
    )
    body = F.concat(_sign(kilobytes), text) if signed else text
    return F.when(kilobytes.isNull(), "--").otherwise(body)
