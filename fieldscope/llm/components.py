"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.session import pin

SALTS = 16
SHARES = 10_000
LEAST_SHARE = 500  # rows


def connected(edges: DataFrame, label: str = "links", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternating star contraction: every node hands its larger neighbours to its smallest one, then its smaller
    ones, until each component is a star. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder, by few tasks if there are only about ``rows`` edges. Neighbours are never gathered: the least is aggregated before the shuffle, and its way back to
    the edges is salted, since the centre of a star may stand in most of them.
    """
    stars = pin(_pairs(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), label, rows)
    before = None
    while True:
        found = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found == before or found["n"] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        before = found
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = _pairs(_with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")))
        smallest = _with_least(larger, larger.groupBy("u").agg(F.min("v").alias("m")))
        both_ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
        stars = pin(_pairs(smallest.select(both_ends).select("x.u", "x.v")), label, rows)


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the m of u."""
    return salted_join(edges, least, "u", "v")


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``table``, which has a row per ``key``; the rows of a key are dealt to SALTS tasks by another column."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def balanced_join(rows: DataFrame, table: DataFrame, key: str, by: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has a row per ``key`` with its ``count`` of the ``total`` rows.

    Keys of over a SHARES-th of the rows are dealt to as many tasks as their share asks for. There are fewer than SHARES such
    keys, whatever the size of the tables, so they can be broadcast; all other keys are joined as they are.
    """
    part = max(total // SHARES, LEAST_SHARE)
    hot = table.where(F.col(count) > part).select(key, F.ceil(F.col(count) / F.lit(part)).cast("int").alias("_parts"))
    parted = rows.join(F.broadcast(hot), key, "left")
    parted = parted.withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / F.lit(part)), F.lit(1)).cast("int") - 1))).drop(count)
    return parted.join(spread, [key, "_salt"]).drop("_salt")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()
