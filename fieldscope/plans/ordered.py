"""Ordered computations (steps between rows, previous row, running total) in two levels.

A plain window over ``key`` sends a key to one task. Here the caller also names
a *chunk*: a column that never decreases along the order inside a key (a snapshot
range, an hour, a bucket of split points). The window runs inside (key, chunk);
one summary row per chunk is carried over to the next chunk of the same key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_points(df: DataFrame, column: str, parts: int = 64, sample_rows: int = 4000) -> list:
    """At most ``parts - 1`` sorted values that cut ``column`` into similar shares.

    Taken from a small random sample. The points only decide which chunk a row falls
    into, so results never depend on them.
    """
    values = df.select(column).filter(F.col(column).isNotNull())
    total = values.count()
    sample = values.sample(fraction=min(1.0, sample_rows / max(1, total)), seed=17)  # about sample_rows of any total
    found = sorted({row[0] for row in sample.collect() if not isinstance(row[0], tuple) or None not in row[0]})
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def bucket_of(column: str, points: Sequence) -> Column:
    """Number of split points at or below the value."""
    if not points:
        return F.lit(0)
    edges = F.array(*[F.lit(p) for p in points])
    return F.size(F.filter(edges, lambda edge: edge <= F.col(column)))


def chunk_of(df: DataFrame, order: Sequence[Column], parts: int = 64, sample_rows: int = 4000) -> Column:
    """A chunk number that never falls along ``order`` (ascending columns), with about as many rows in each chunk.

    Cut points are rows of a random sample, compared by the whole order: equal leading values, such as all
    rows of one minute, are cut by what comes after them.
    """
    names = [f"_c{i}" for i in range(len(order))]
    keyed = df.select(F.struct(*[c.alias(n) for c, n in zip(order, names)]).alias("_o"))
    points = split_points(keyed, "_o", parts, sample_rows)
    if not points:
        return F.lit(0)
    kinds = [f.dataType for f in keyed.schema["_o"].dataType.fields]
    edges = F.array(*[F.struct(*[F.lit(p[n]).cast(k).alias(n) for n, k in zip(names, kinds)]) for p in points])
    here = F.struct(*[c.alias(n) for c, n in zip(order, names)])
    return F.size(F.filter(edges, lambda edge: edge <= here))


def transition_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cols: Sequence[str],
    measures: Mapping[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """Per key: the sum of each measure over consecutive rows, and the first and last row.

    A measure maps (previous row, row) to a number or null. Rows are shuffled once, by
    (key, chunk); what crosses a chunk border is added from one row per chunk.
    """
    row = F.struct(*order, *[c for c in cols if c not in order])
    here, prev, zero = F.col("_row"), F.col("_prev"), F.lit(0).cast("bigint")
    known = lambda value: F.coalesce(value, zero)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    across = W.partitionBy(*keys).orderBy("_chunk")
    upto = lambda window: window.rowsBetween(W.unboundedPreceding, 0)
    # Sums run along a window and its last row has them all: no aggregate of structs, which would be by sorting.
    stepped = df.withColumn("_chunk", chunk).select(
        *keys, "_chunk", *order, row.alias("_row"), F.lag(row).over(inside).alias("_prev"), F.lead(F.lit(1)).over(inside).alias("_more"),
        F.first(row).over(upto(inside)).alias("first"),
    )
    steps = {name: F.when(prev.isNotNull(), known(step(prev, here))).otherwise(zero) for name, step in measures.items()}
    chunks = (
        stepped.withColumns(steps)
        .withColumns({name: F.sum(name).over(upto(inside)) for name in measures})
        .filter(F.col("_more").isNull())
        .select(*keys, "_chunk", *measures, "first", here.alias("last"))
    )
    linked = chunks.withColumns(
        {"_prev": F.lag("last").over(across), "_more": F.lead(F.lit(1)).over(across), "_first": F.first("first").over(upto(across))}
    )
    borders = {
        name: F.col(name) + F.when(prev.isNotNull(), known(step(prev, F.col("first")))).otherwise(zero) for name, step in measures.items()
    }
    return (
        linked.withColumns(borders)
        .withColumns({name: F.sum(name).over(upto(across)) for name in measures})
        .filter(F.col("_more").isNull())
        .select(*keys, *measures, F.col("_first").alias("first"), "last")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cols: Sequence[str],
    out: str = "prev",
) -> DataFrame:
    """Add struct ``out`` with ``cols`` of the previous row of the key, null on its first row."""
    packed = F.struct(*[F.col(c) for c in cols])
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    local = (
        df.withColumn("_chunk", chunk)
        .withColumn("_near", F.lag(packed).over(inside))
        .withColumn("_more", F.lead(F.lit(1)).over(inside))
    )
    tails = local.filter(F.col("_more").isNull()).select(*keys, "_chunk", packed.alias("_tail"))
    carried = (
        tails.withColumn("_far", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_chunk")))
        .filter(F.col("_far").isNotNull())
        .select(*keys, "_chunk", "_far")
    )
    return (
        local.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_near", "_far", "_more", "_chunk")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    value: Column,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    With ``value = lit(1)`` this is a row number. ``chunk`` must rise along
    ``order``, or fall when ``descending`` is set.
    """
    step = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    chunked = df.withColumn("_chunk", chunk).withColumn("_v", value.cast("bigint"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.sum("_v").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .filter(F.col("_base") != 0)
        .select(*keys, "_chunk", "_base")
    )
    return (
        chunked.withColumn("_run", F.sum("_v").over(inside))
        .join(offsets, [*keys, "_chunk"], "left")
        .withColumn(out, F.col("_run") + F.coalesce("_base", F.lit(0)))
        .drop("_chunk", "_v", "_run", "_base")
    )
