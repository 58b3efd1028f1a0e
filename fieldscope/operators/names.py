"""Which global roots belong to an addon: containment of normalised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.text import normalize_name
from fieldscope.plans import bucket_of, running_total, split_points, top_per_key

SHORTEST = 4


def _parts(name: Column, lengths: list[int]) -> Column:
    """All substrings of the given lengths."""
    size = F.length(name)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= size)
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.substring(name, s, n))
    return F.array_distinct(F.flatten(F.transform(fitting, cut)))


def _lengths(names: DataFrame, column: str) -> list[int]:
    """The lengths that occur: a few dozen numbers."""
    return sorted(row[0] for row in names.select(F.length(column)).distinct().collect())


def name_match_roots(keys: DataFrame, addons: DataFrame, most: int | None = None) -> DataFrame:
    """For each ``addon`` the keys (the first ``most`` if given) whose normalised name equals, contains or
    is contained in the addon's, by key; ``matches`` counts all of them.

    Containment is an equality between one name and a substring of the other, so this
    is two hash joins that produce matches only. Equal normalised names are matched once. Only parts as long as some
    name on the other side are looked up.
    """
    named = keys.select("key", normalize_name(F.col("key")).alias("norm")).filter(F.length("norm") >= SHORTEST).distinct()
    owners = addons.select("addon", normalize_name(F.col("addon")).alias("addon_norm")).filter(
        F.length("addon_norm") >= SHORTEST
    ).distinct()
    key_norms = named.select("norm").distinct()
    addon_norms = owners.select("addon_norm").distinct()

    key_holds = key_norms.select("norm", F.explode(_parts(F.col("norm"), _lengths(addon_norms, "addon_norm"))).alias("addon_norm")).join(addon_norms, "addon_norm")
    addon_holds = addon_norms.select("addon_norm", F.explode(_parts(F.col("addon_norm"), _lengths(key_norms, "norm"))).alias("norm")).join(key_norms, "norm")
    matches = key_holds.select("addon_norm", "norm").unionByName(addon_holds.select("addon_norm", "norm")).distinct()

    pairs = matches.join(named.select("norm", "key"), "norm").select("addon_norm", "key")
    totals = pairs.groupBy("addon_norm").agg(F.count(F.lit(1)).alias("matches"))
    if most is None:
        by_norm = running_total(pairs, ["addon_norm"], [F.col("key")], bucket_of("key", split_points(pairs, "key")), F.lit(1), "rank")
    else:
        by_norm = top_per_key(pairs, ["addon_norm"], [F.col("key")], most)
    return owners.join(by_norm, "addon_norm").join(totals, "addon_norm").select("addon", "key", "rank", "matches")
