"""Skew-safe plan patterns against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldscope.plans import quantiles
from fieldscope.plans.quantiles import with_code
from fieldscope.plans.spread import portions
from fieldscope.plans import bucket_of, chunk_of, nearest_rank, previous_row, running_total, split_points, top_per_key, transition_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns a third of the rows; values repeat, are negative, zero and missing."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        value = None if i % 11 == 0 else round(rng.choice([rng.uniform(-3, 3), rng.expovariate(0.01), 0.0, 5.0]), 3)
        data.append((key, i, value, rng.random() < 0.5))
    return data, spark.createDataFrame(data, "k int, i long, v double, shown boolean").repartition(5).cache()


def by_key(data):
    out = {}
    for row in data:
        out.setdefault(row[0], []).append(row)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


def test_nearest_rank_equals_sorted_position(skewed):
    data, df = skewed
    points = [("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p100", 1.0)]
    got = {r.k: r for r in nearest_rank(df, ["k"], {"v": points}).collect()}
    for key, part in by_key(data).items():
        values = sorted(r[2] for r in part if r[2] is not None)
        if not values:
            assert key not in got
            continue
        for name, p in points:
            assert got[key][name] == values[max(1, math.ceil(len(values) * p)) - 1]


def test_codes_have_the_order_of_doubles(spark):
    import struct

    rng = random.Random(3)
    values = [0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1.7976931348623157e308, float("inf"), float("-inf"), 4e-7, 2.0**52 + 1, 8.0, 1e23]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1020, 1024)]
    values = [v for v in values if v == v]
    got = with_code(spark.createDataFrame([(v,) for v in values], "v double"), "v", "c").collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [r.c for r in got] == [bits(r.v) for r in got]
    odd = with_code(spark.sql("select explode(array(double('inf'), double('NaN'))) as v"), "v", "c").collect()
    assert odd[0].c < odd[1].c


@pytest.mark.parametrize("few, most", [(1 << 16, 200_000), (0, 200_000), (0, 0)])
@pytest.mark.parametrize("value", ["1.0e9 + id * 10.0", "1.0e-9 + id * 1e-11", "1.0 + id * 2.3e-16", "cast(id % 3 as double) - 1", "-id * 1e300"])
def test_close_values_are_told_apart(spark, monkeypatch, few, most, value):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "MOST", most)
    df = spark.range(20_000).selectExpr("1 as k", f"{value} as v")
    held = sorted(r.v for r in df.collect())
    got = nearest_rank(df, ["k"], {"v": [("a", 0.5), ("b", 0.999), ("c", 0.0)]}).collect()
    assert [tuple(r) for r in got] == [(1, held[9_999], held[19_979], held[0])]


def test_small_values_do_not_share_a_prefix(spark):
    df = spark.range(100_000).selectExpr("1 as k", "1e-9 + id * 2e-11 as v")
    largest = with_code(df, "v", "c").groupBy(F.shiftright("c", quantiles.SHIFTS[0])).count().agg(F.max("count")).first()[0]
    assert largest < 5_000


def test_chunks_cut_rows_that_share_their_first_column(spark):
    df = spark.range(5000).selectExpr("1 as k", "7 as minute", "id")
    chunk = chunk_of(df, [F.col("minute"), F.col("id")])
    sizes = [r["count"] for r in df.groupBy(chunk.alias("c")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 500
    ranked = running_total(df, ["k"], [F.col("minute"), F.col("id")], chunk, F.lit(1), "n")
    assert all(r.n == r.id + 1 for r in ranked.collect())


def test_exact_sum_keeps_small_samples(spark):
    from fieldscope.functions.numbers import exact_sum

    df = spark.range(1000).selectExpr("4e-7D as small", "1e16D as large", "0.1D as tenth", "cast(null as double) as none", "if(id = 0, 1e12D, 1e-9D) as both")
    row = df.agg(*[exact_sum(F.col(c)).alias(c) for c in df.columns]).collect()[0]
    assert (row.small, row.large, row.tenth, row.none, row.both) == (4e-4, 1e19, 100.0, None, 1e12 + 999e-9)


def test_nearest_rank_small_counts(spark):
    data = [(n, float(v)) for n in range(1, 60) for v in range(n)]
    df = spark.createDataFrame(data, "n int, v double")
    for r in nearest_rank(df, ["n"], {"v": [("a", 0.5), ("b", 0.95), ("c", 0.99)]}).collect():
        for got, p in ((r.a, 0.5), (r.b, 0.95), (r.c, 0.99)):
            assert got == max(1, math.ceil(r.n * p)) - 1


@pytest.mark.parametrize("salts", [1, 7])
def test_top_per_key(skewed, salts):
    data, df = skewed
    got = top_per_key(df, ["k"], [F.col("i").desc()], 6, salts=salts).collect()
    for key, part in by_key(data).items():
        want = [r[1] for r in part][::-1][:6]
        assert [r.i for r in sorted((r for r in got if r.k == key), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("size", [1, 10, 400, 100000])
def test_previous_row_does_not_depend_on_chunks(skewed, size):
    data, df = skewed
    got = {r.i: r.prev for r in previous_row(df, ["k"], ["i"], F.floor(F.col("i") / size), ["i", "shown"]).collect()}
    for part in by_key(data).values():
        for before, row in zip([None, *part], part):
            prev = got[row[1]]
            assert (prev is None and before is None) or (prev.i, prev.shown) == (before[1], before[3])


@pytest.mark.parametrize("size", [1, 10, 100000])
def test_transition_totals_do_not_depend_on_chunks(skewed, size):
    data, df = skewed
    on = {"on": lambda a, b: (b["shown"] & ~a["shown"]).cast("long")}
    got = {r.k: r for r in transition_totals(df, ["k"], ["i"], F.floor(F.col("i") / size), ["shown"], on).collect()}
    for key, part in by_key(data).items():
        assert got[key].on == sum(b[3] and not a[3] for a, b in zip(part, part[1:]))
        assert (got[key].first.i, got[key].last.i) == (part[0][1], part[-1][1])


@pytest.mark.parametrize("size", [1, 37, 100000])
@pytest.mark.parametrize("down", [False, True])
def test_running_total(skewed, size, down):
    data, df = skewed
    order = F.col("i").desc() if down else F.col("i").asc()
    out = running_total(df, ["k"], [order], F.floor(F.col("i") / size), F.col("i"), "total", descending=down)
    got = {r.i: r.total for r in out.collect()}
    for part in by_key(data).values():
        total = 0
        for row in part[::-1] if down else part:
            total += row[1]
            assert got[row[1]] == total


def test_split_points_cut_in_order(spark):
    df = spark.createDataFrame([(f"name{i:05d}",) for i in range(900)], "key string")
    points = split_points(df, "key", parts=8)
    assert points == sorted(points) and len(points) == 7
    counts = [r["count"] for r in df.groupBy(bucket_of("key", points).alias("b")).count().collect()]
    assert len(counts) == 8 and max(counts) < 300
    ranked = running_total(df, [], [F.col("key")], bucket_of("key", points), F.lit(1), "rn")
    assert [r.rn for r in ranked.orderBy("key").collect()] == list(range(1, 901))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_are_cut_before_the_shuffle(skewed):
    plan = plan_of(top_per_key(skewed[1], ["k"], [F.col("i").desc()], 6))
    assert plan.count("Partial") == 2 and "_shard" in plan


def test_hot_keys_are_shuffled_by_chunk(skewed):
    plan = plan_of(transition_totals(skewed[1], ["k"], ["i"], F.floor(F.col("i") / 10), ["shown"], {}))
    first = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "_chunk" in first
    plan = plan_of(nearest_rank(skewed[1], ["k"], {"v": [("p", 0.5)]}))
    lines = plan.splitlines()
    counted = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "_p#" in line)
    assert "partial_count" in lines[counted + 1]  # what is shuffled are counts


def test_keys_of_few_rows_are_sorted_beside_hot_ones(spark):
    rows = [(k, None if k % 7 == 0 else float((i * 37 + k) % 101) - 50, float(i)) for k in range(300) for i in range(1 + k % 9)]
    rows += [(1000, float(i * 7919 % 3001), None) for i in range(3000)] + [(None, 1.0, 1.0)]
    points = {"v": [("a", 0.0), ("b", 0.5), ("c", 0.95)], "w": [("d", 1.0)]}
    small = spark.createDataFrame([r for r in rows if r[0] != 1000], "k int, v double, w double")
    assert "_p#" not in plan_of(nearest_rank(small, ["k"], points))  # no counts by prefix where no key has many rows
    got = {r.k: tuple(r)[1:] for r in nearest_rank(spark.createDataFrame(rows, "k int, v double, w double"), ["k"], points).collect()}
    held = {}
    for k, v, w in rows:
        held.setdefault(k, ([], []))[0].append(v)
        held[k][1].append(w)
    at = lambda values, p: (lambda s: s[max(1, math.ceil(len(s) * p)) - 1] if s else None)(sorted(x for x in values if x is not None))
    assert got == {k: (at(v, 0.0), at(v, 0.5), at(v, 0.95), at(w, 1.0)) for k, (v, w) in held.items() if k is not None}


def test_codes_of_hot_keys_are_worked_out_once(skewed):
    plan = nearest_rank(skewed[1].filter("k = 0"), ["k"], {"v": [("p", 0.5)]})._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG2" not in plan.upper()  # the levels read the codes that the first pass wrote


def test_portions_hold_a_bounded_number_of_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 500)
    cores = spark.sparkContext.defaultParallelism
    assert portions(df, "k", rows=1000 // cores + 1) is df  # few rows stay as they are
    dealt = portions(df, "k", rows=50)
    assert dealt.rdd.getNumPartitions() == 20
    totals = dealt.groupBy("k", (F.col("id") % 2).alias("odd")).agg(F.sum("id").alias("s"))
    assert plan_of(totals).count("Exchange") == 1  # the aggregate needs no shuffle of its own
    assert sorted((r.k, r.s) for r in totals.collect()) == [(k, 2 * k + 500) for k in range(500)]
