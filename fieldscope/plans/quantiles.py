"""Exact nearest-rank percentiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscope.session import pin

# Bits of the code that are left out at each level: sign, exponent and five bits of the fraction first, then 16 at a time.
SHIFTS = (47, 31, 15, 0)
FEW = 1 << 16  # values below one prefix that are put in order at once
SMALL = 256  # rows of a key that are sorted as they are: so few hardly share a prefix, and counting them saves nothing
MOST = 200_000  # ranks looked for that go to all tasks: some 60 bytes and the key each


def with_code(df: DataFrame, value: str, code: str) -> DataFrame:
    """Add a 64-bit integer for each double, in the order of the doubles: the bits of its size, negated below zero. Both zeros have 0.

    Steps are columns of their own, so that each is worked out once.
    """
    size, finite = F.abs(value), ~F.isnan(value) & (F.abs(value) < float("inf"))
    normal = finite & (size >= 2.0**-1022)
    steps = df.withColumn("_size", F.when(normal, size).otherwise(1.0)).withColumn("_guess", F.floor(F.log2("_size")).cast("int"))
    steps = steps.withColumn("_near", F.col("_size") / F.pow(F.lit(2.0), "_guess"))
    steps = steps.withColumn("_power", F.col("_guess") + F.when(F.col("_near") >= 2, 1).when(F.col("_near") < 1, -1).otherwise(0))
    exact = F.when(F.col("_power") == F.col("_guess"), F.col("_near")).otherwise(F.col("_size") / F.pow(F.lit(2.0), "_power"))
    bits = (
        F.when(normal, (F.col("_power") + 1023).cast("bigint") * (1 << 52) + ((exact - 1) * 2.0**52).cast("bigint"))
        .when(finite, (F.when(normal, 0.0).otherwise(size) * 2.0**537 * 2.0**537).cast("bigint"))
        .when(F.isnan(value), F.lit((2047 << 52) + (1 << 51)))
        .otherwise(F.lit(2047 << 52))
    )
    sign = F.when((F.col(value) < 0) & ~F.isnan(value), -1).otherwise(1)
    return steps.withColumn(code, bits).withColumn(code, F.col(code) * sign).drop("_size", "_guess", "_near", "_power")


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    points: Mapping[str, Sequence[tuple[str, float]]],
) -> DataFrame:
    """``sorted[max(1, ceil(n * p))]`` per key; null (no row) when a key has no value.

    ``points`` maps a numeric column to ``(alias, p)`` pairs; one column per alias
    comes out. Rows of a key are counted first: up to 256 are sorted in one group, which takes one shuffle however many
    keys there are; more are never gathered (see ``_radix_rank``).
    """
    sizes = pin(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).dropna(subset=list(keys)), "sizes")
    large = sizes.filter(F.col("_rows") > SMALL).select(*keys)
    count = sizes.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("_rows") > SMALL).alias("large")).first()
    if not count["large"]:
        return _sorted_rank(df, keys, points)
    if count["large"] == count["all"]:
        return _radix_rank(df, keys, points)
    few = F.broadcast(large) if count["large"] <= MOST else large
    return _sorted_rank(df.join(few, list(keys), "left_anti"), keys, points).unionByName(
        _radix_rank(df.join(few, list(keys), "left_semi"), keys, points)
    )


def _sorted_rank(df: DataFrame, keys: Sequence[str], points: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """Ranks of keys of few rows: each column's values in order, and the value at the place asked for."""
    ordered = [F.sort_array(F.collect_list(F.col(name).cast("double"))).alias(f"_v{i}") for i, name in enumerate(points)]
    known = df.dropna(subset=list(keys)).groupBy(*keys).agg(*ordered)
    known = known.filter(F.greatest(*[F.size(f"_v{i}") for i in range(len(points))], F.lit(0)) > 0)

    def at(values: str, p: float) -> Column:
        return F.get(values, F.greatest(F.lit(1), F.ceil(F.size(values).cast("double") * F.lit(float(p)))).cast("int") - 1)

    return known.select(*keys, *[at(f"_v{i}", p).alias(a) for i, pairs in enumerate(points.values()) for a, p in pairs])


def _radix_rank(df: DataFrame, keys: Sequence[str], points: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """Ranks of keys of any size by radix selection.

    Values are counted by the first bits of their code, before the shuffle, which tells
    the prefix that holds each rank; only values with that prefix are then counted by the bits that follow, and so on. No
    value crosses a shuffle but as a count, and a prefix has no more than 65,536 parts to put in order. Values and their
    codes are written to the shared folder once.
    """
    measures = F.array(
        *[F.struct(F.lit(name).alias("m"), F.col(name).cast("double").alias("v")) for name in points]
    )
    values = (
        df.select(*keys, F.explode(measures).alias("_x"))
        .select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
        .filter(F.col("_v").isNotNull())
    )
    values = pin(with_code(values, "_v", "_code"), "codes")  # read once per level: working a code out takes longer than reading it
    wanted = F.create_map(
        *[
            part
            for name, pairs in points.items()
            for part in (
                F.lit(name),
                F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(float(p)).alias("p")) for a, p in pairs]),
            )
        ]
    )
    group = [*keys, "_m"]
    by_measure = W.partitionBy(*group)
    upto = by_measure.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    ranks = (
        values.groupBy(*group, F.shiftright("_code", SHIFTS[0]).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cum", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(by_measure))
        .withColumn("_t", F.explode(F.element_at(wanted, F.col("_m"))))
        .withColumn("_at", F.greatest(F.lit(1), F.ceil(F.col("_all").cast("double") * F.col("_t.p"))))
    )
    found = _holding(ranks).select(*group, F.col("_t.alias").alias("_alias"), "_p", "_at", "_n")
    level = 0
    while SHIFTS[level]:
        found = pin(found, "ranks")
        sizes = found.agg(F.count(F.lit(1)).alias("ranks"), F.max("_n").alias("most")).first()
        before = SHIFTS[level]
        level = len(SHIFTS) - 1 if (sizes["most"] or 0) <= FEW else level + 1
        shift = SHIFTS[level]
        prefixes = found.select(*group, F.col("_p").alias("_of")).distinct()
        here = [F.shiftright("_code", before).alias("_of"), F.shiftright("_code", shift).alias("_p")]
        of_prefix = found.select(*group, "_alias", F.col("_p").alias("_of"), "_at")
        if sizes["ranks"] <= MOST:
            of_prefix = F.broadcast(of_prefix)
            counts = values.select(*group, "_v", *here).join(F.broadcast(prefixes), [*group, "_of"], "left_semi")
            counts = counts.groupBy(*group, "_of", "_p").agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_v"))
        else:  # as many ranks as that come from many keys: count first, then keep what is looked for
            counts = values.groupBy(*group, *here).agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_v"))
            counts = counts.join(prefixes, [*group, "_of"], "left_semi")
        inside = W.partitionBy(*group, "_of").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
        ranks = counts.withColumn("_cum", F.sum("_n").over(inside)).join(of_prefix, [*group, "_of"])
        found = _holding(ranks).select(*group, "_alias", "_p", "_at", "_n", "_v")
    aliases = [alias for pairs in points.values() for alias, _ in pairs]
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_alias") == a, F.col("_v"))).alias(a) for a in aliases])


def _holding(ranks: DataFrame) -> DataFrame:
    """The rows whose counts reach the rank, with the rank inside them."""
    first = F.col("_cum") - F.col("_n")
    return ranks.filter((F.col("_at") <= F.col("_cum")) & (F.col("_at") > first)).withColumn("_at", F.col("_at") - first)
