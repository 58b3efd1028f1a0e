"""Text rules of events, errors, paths and reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: what an event name looks like.
EVENT_NAME = "[A-Z][A-Z0-9_]*"


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def byte_truncate(text: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` bytes plus ``marker``; never cuts a character in two."""
    raw = text.cast("binary")

    def inner_byte(at: int) -> Column:
        return F.hex(F.substring(raw, at, 1)).between("80", "BF")

    keep = (
        F.when(~inner_byte(limit + 1), limit)
        .when(~inner_byte(limit), limit - 1)
        .when(~inner_byte(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    cut = F.substring(raw, F.lit(1), keep).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(marker)))


def quoted(text: Column) -> Column:
    """Double-quoted, with quotes, backslashes, line ends and NUL escaped."""
    escaped = F.regexp_replace(text, r'(["\\\n])', r"\\$1")
    escaped = F.replace(F.replace(escaped, F.lit("\r"), F.lit("\\r")), F.lit("\0"), F.lit("\\0"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def format_argument(kind: Column, text: Column, limit: int = 256) -> Column:
    """One event or call argument: quoted string, plain scalar, or its type in angle brackets."""
    shown = (
        F.when(kind == "secret", "<secret>")
        .when(kind == "string", quoted(text))
        .when(kind.isin("number", "boolean"), text)
        .when(kind == "nil", "nil")
        .otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    )
    return byte_truncate(shown, limit, "...")


def format_arguments(args: Column, most: int = 16, limit: int = 256) -> Column:
    """The first ``most`` arguments formatted, plus a marker for the rest."""
    extra = F.size(args) - most
    shown = F.transform(F.slice(args, 1, most), lambda a: format_argument(a["type"], a["text"], limit))
    marker = F.concat(F.lit("<"), extra.cast("string"), F.lit(" more arguments>"))
    return F.when(extra > 0, F.concat(shown, F.array(marker))).otherwise(shown)


def argument_lines(shown: Column, empty: str) -> Column:
    """``[i] = argument`` lines."""
    lines = F.transform(shown, lambda a, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] = "), a))
    return F.when(F.size(shown) == 0, empty).otherwise(F.array_join(lines, "\n"))


def source_attribution(location: Column) -> Column:
    """Struct (source, source_file) of an ``Interface\\AddOns\\<addon>\\<file>:<line>`` location."""
    path = F.replace(location, F.lit("/"), F.lit("\\"))
    pattern = r"(?s)[Ii]nterface\\[Aa]dd[Oo]ns\\([^\\]+)\\(.+):(\d+)"
    addon = F.regexp_extract(path, pattern, 1)
    own = addon != ""
    game = path.rlike("[Bb]lizzard|[Ff]rame[Xx][Mm][Ll]")
    return F.struct(
        F.coalesce(F.nullif(addon, F.lit("")), F.when(game, "Blizzard").otherwise("unknown")).alias("source"),
        F.when(own, F.concat(F.regexp_extract(path, pattern, 2), F.lit(":"), F.regexp_extract(path, pattern, 3)))
        .otherwise(path)
        .alias("source_file"),
    )


def error_source(source: Column, message: Column, stack: Column) -> Column:
    """The stated source, else the first addon folder in message and stack, else ``unknown``."""
    both = F.replace(
        F.concat(F.coalesce(message, F.lit("")), F.lit("\n"), F.coalesce(stack, F.lit(""))), F.lit("\\"), F.lit("/")
    )
    found = F.regexp_extract(both, r"[Aa]dd[Oo]ns/([^/\s]+)", 1)
    return F.coalesce(F.nullif(source, F.lit("")), F.nullif(found, F.lit("")), F.lit("unknown"))


def format_time(epoch_seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, ``unknown`` for zero, negative or missing."""
    days = F.date_from_unix_date(F.floor(epoch_seconds / 86400).cast("int"))
    second = F.pmod(epoch_seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.when(epoch_seconds > 0, F.concat(days.cast("string"), F.lit(" "), clock)).otherwise("unknown")


def normalize_name(name: Column) -> Column:
    """Lower case without colour codes and without anything but ASCII letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\|c[0-9a-f]{8}", "")
    return F.regexp_replace(F.replace(plain, F.lit("|r"), F.lit("")), "[^a-z0-9]", "")


def variable_names(*declarations: Column) -> Column:
    """Distinct identifiers of the declarations, in order of first appearance."""
    found = [
        F.regexp_extract_all(F.coalesce(d, F.lit("")), F.lit("([_A-Za-z][_0-9A-Za-z]*)"), F.lit(1)) for d in declarations
    ]
    return F.array_distinct(F.concat(*found))


def first_line_preview(text: Column, limit: int = 22, default: str = "(empty)") -> Column:
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"([^\r\n]+)", 1)
    return F.when(line == "", default).otherwise(byte_truncate(line, limit, "..."))


def code_normalize(code: Column) -> Column:
    """Trimmed, without a leading ``/run`` or ``/script``."""
    return F.regexp_replace(trimmed(F.coalesce(code, F.lit(""))), r"(?i)^/(run|script)\s+", "")


def event_name(query: Column) -> Column:
    """Trimmed and upper-cased; the Chinese words for "all" and "all events" mean ALL."""
    name = F.upper(trimmed(F.coalesce(query, F.lit(""))))
    return F.when(name.isin("全部", "全部事件"), "ALL").otherwise(name)


def valid_event_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{EVENT_NAME}$"), F.lit(False))


def placeholders(text: Column) -> Column:
    """Format placeholders of a label, in order."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(%[0-9$+\-.# ]*[cdeEfgGiouXxqs])"), F.lit(1)), "|")
