"""Uniform shuffles into shards of exact sizes.

Method: a communication matrix says how many rows of each input partition go to each shard. Drawn from the multivariate
hypergeometric distribution with the partitions' and shards' sizes as margins, permuted locally, exchanged and permuted
again, it gives every arrangement of the rows the same chance. No task needs the whole matrix: partitions are halved again
and again, the draw at each half has a seed of its own, and a partition follows the halves down to its own row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm import blocks
from fieldscope.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_TASKS = 1 << 20  # input partitions whose sizes go to all tasks: 8 MB
MOST_CELLS = 1 << 20  # pieces of shards whose first slots may be broadcast: 12 MB
CELL = 32 << 20  # bytes of text that one task permutes and writes
EXACT = 10**9  # numpy draws from populations below this


def rise(x: float, d: float) -> float:
    """log gamma(x + d) - log gamma(x), without losing digits where x is large."""
    y = x + d
    if min(x, y) < 1e4:
        return math.lgamma(y) - math.lgamma(x)
    return (y - 0.5) * math.log1p(d / x) + d * (math.log(x) - 1) + (1 / y - 1 / x) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` from good and bad are good, for populations of any size.

    By ratio of uniforms around the mode; where few are expected by adding up chances from 0.
    """
    total = good + bad
    if good > bad:
        return drawn - hypergeometric(rng, bad, good, drawn)
    if 2 * drawn > total:
        return good - hypergeometric(rng, good, bad, total - drawn)
    most = min(good, drawn)
    if most == 0:
        return 0
    mean = drawn * good / total
    if mean < 10:
        # the chance of none: (bad! (total - drawn)!) / (total! (bad - drawn)!)
        chance = math.exp(rise(bad - drawn + 1, drawn) - rise(total - drawn + 1, drawn))
        left, k = rng.random(), 0
        while left > chance and k < most:
            left -= chance
            chance *= (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
            k += 1
        return k
    variance = mean * (bad / total) * ((total - drawn) / (total - 1))
    mode = (drawn + 1) * (good + 1) // (total + 2)
    width = 1.7155277699214135 * math.sqrt(variance + 0.5) + 0.8989161620588988  # 2 sqrt(2/e), 3 - 2 sqrt(3/e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if 0 <= k <= most:
            d = k - mode
            ratio = rise(mode + 1, d) + rise(good - mode + 1, -d) + rise(drawn - mode + 1, -d) + rise(bad - drawn + mode + 1, d)
            if 2 * math.log(u) <= -ratio:
                return k


def drawn_from(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows fall to each of the sizes."""
    left = int(sizes.sum())
    if left < EXACT:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    out = np.zeros(len(sizes), np.int64)
    for j, size in enumerate(sizes.tolist()):
        out[j] = hypergeometric(rng, size, left - size, n)
        n, left = n - int(out[j]), left - size
    return out


def matrix_row(part: int, before: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of partition ``part`` go to each shard; ``before`` has the rows before each partition, and their total."""
    low, high, held = 0, len(before) - 1, sizes
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, 1, low, high])
        left = drawn_from(rng, held, int(before[middle] - before[low]))
        held, low, high = (left, low, middle) if part < middle else (held - left, middle, high)
    return held


def destinations(part: int, before: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each row of a partition, and its random place there: a key of 63 bits."""
    rng = np.random.default_rng([seed, 2, part])
    shards = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(part, before, sizes, seed)))
    return shards, rng.integers(1 << 63, size=len(shards), dtype=np.int64)


def cells_of(shards: np.ndarray, keys: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of a shard that a key falls in; pieces are numbered through all shards in order."""
    return shards.astype(np.int64) * pieces + ((keys >> 31) * pieces >> 32)


def read_again_alike(docs: DataFrame) -> DataFrame:
    """``docs``, or a copy in the shared folder if its rows come out of a shuffle, whose order may change from one read to another."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return pin(docs, "sharding") if "Exchange" in plan else docs


def uniform_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 11, text: str = "text") -> DataFrame:
    """Write all rows to ``path`` (Parquet, a folder per shard), and return what was written.

    Every arrangement of the rows over shards and slots is as likely as any other, and depends on ``seed`` and on how the
    input is split only. Sizes of shards are at most one row apart, the first ones are the larger. Columns stay, and shard (int) and slot (long,
    gapless from 0 within a shard, ascending within and across its files) join them; input columns of these names get underscores
    before. Rows that repeat, null ids and null texts are rows like others, and equal texts are not kept together. No
    rows: no files.
    """
    spark = docs.sparkSession
    docs = read_again_alike(docs)
    for name in ("shard", "slot"):
        held = next((c for c in docs.columns if c.lower() == name), None)
        if held:
            docs = docs.withColumnRenamed(held, blocks.spare(name, docs.columns))
    columns, text = docs.columns, text if text in docs.columns else blocks.spare(text, docs.columns)
    cell, key, at = (blocks.spare(n, columns) for n in ("_cell", "_key", "_at"))

    def tallied(rows: DataFrame) -> DataFrame:
        size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 64
        return pin(rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")), "sharding")

    tally = tallied(docs)
    if tally.count() > MOST_TASKS:
        docs = docs.coalesce(MOST_TASKS)
        tally = tallied(docs)
    counted = sorted((r["part"], r["n"], r["bytes"]) for r in tally.collect())  # a number per task, MOST_TASKS at most
    names = np.array([p for p, _, _ in counted], np.int64)
    before = np.concatenate(([0], np.cumsum([n for _, n, _ in counted], dtype=np.int64)))
    total = int(before[-1])
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    pieces = blocks.shares(sum(b for _, _, b in counted) // shards, CELL)

    def sent(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part, to = None, None
        for place in places:
            place = place.to_numpy()
            if len(place) and part != place[0] >> 33:
                part = place[0] >> 33
                number = int(np.searchsorted(names, part))
                to = destinations(number, before, sizes, seed)
            where = place & ((1 << 33) - 1)
            if len(place) and where[-1] >= len(to[0]):
                raise ValueError("a partition has more rows than when it was counted")
            held = [x[where] for x in to] if len(place) else [np.zeros(0, np.int32), np.zeros(0, np.int64)]
            yield pa.StructArray.from_arrays([pa.array(cells_of(*held, pieces), pa.int32()), pa.array(held[1], pa.int64())], ["cell", "key"])

    def simulated(batches):
        for batch in batches:
            for part in batch["part"].to_pylist():
                to = destinations(int(np.searchsorted(names, part)), before, sizes, seed)
                found, n = np.unique(cells_of(*to, pieces), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["_cell", "n"])

    # Where rows go depends on the partitions' sizes alone, so the pieces' sizes are known without the rows.
    held = tally.repartition("part").mapInArrow(simulated, "_cell int, n long").groupBy("_cell").agg(F.sum("n").alias("n"))
    of_shard = Window.partitionBy(F.expr(f"_cell div {pieces}")).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pin(held.select(F.col("_cell").alias(cell), F.coalesce(F.sum("n").over(of_shard), F.lit(0)).alias("_first")), "sharding")
    if shards * pieces <= MOST_CELLS:
        firsts = F.broadcast(firsts)

    to = F.arrow_udf(sent, "struct<cell int, key long>")
    dealt = docs.withColumn(at, F.monotonically_increasing_id()).withColumn(cell, to(at))
    dealt = dealt.withColumn(key, F.col(f"{cell}.key")).withColumn(cell, F.col(f"{cell}.cell"))
    dealt = dealt.withColumn("shard", F.expr(f"cast({cell} div {pieces} as int)"))
    # A piece is a partition, so that the place in the partition is the place in the piece.
    moved = dealt.repartitionById(shards * pieces, F.col(cell)).sortWithinPartitions("shard", key, at)
    numbered = moved.withColumn("slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).join(firsts, cell)
    written = numbered.withColumn("slot", F.col("_first") + F.col("slot")).select(*[F.col(f"`{c}`") for c in columns], "slot", "shard")
    written.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(written.schema).parquet(path)
