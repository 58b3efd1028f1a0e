"""First rows per key, with hot keys spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", salts: int = 256
) -> DataFrame:
    """The first ``n`` rows of every key in ``order``, numbered from 1.

    A row can only be among the first ``n`` of its key if it is among the first ``n`` of
    the input tasks it shares a shard with. Shards are made of whole input tasks, and
    ``row_number() <= n`` is also applied before a shuffle, so each task hands on at
    most ``n`` rows of a key, a shard receives those of its tasks only, and the final
    rank sees at most ``salts * n`` rows of any key.
    """
    sharded = df.withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(salts)))
    shard = W.partitionBy(*keys, "_shard").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        sharded.withColumn(rank, F.row_number().over(shard))
        .filter(F.col(rank) <= n)
        .drop("_shard")
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= n)
    )
