"""Token buckets whose keys are spread over tasks, against a plain loop over all requests."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from brindle.operators import monitoring

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def loop(requests, levels, cost):
    """requests are (key, us, order); which are allowed, in whole microseconds of refill."""
    state, out = {}, {}
    for key, us, i in sorted(requests, key=lambda r: (repr(r[0]), r[1], r[2])):
        ok = True
        for j, (rate, capacity) in enumerate(levels):
            unit = 1e6 / rate if rate else 1e6
            full, price = round(capacity * unit), round(cost * unit)
            left, at = state.get((key, j), (full, us))
            left = min(full, left + (us - at if rate else 0))
            ok = left >= price
            state[key, j] = (left - price * ok, us)
            if not ok:
                break
        out[i] = ok
    return out


@pytest.mark.parametrize("levels", [[(0.5, 3.0)], [(0.0, 5.0)], [(1.0, 4.0), (0.25, 10.0)], [(2.0, 0.5)], [(1 / 3, 40.0), (0.0, 50.0), (0.1, 2.5)]])
def test_buckets_equal_a_loop(spark, levels):
    r = random.Random(5)
    rows, us = [], 0
    for i in range(1500):
        us += r.choice([0, 1, 100_000, 700_000, 3_000_000])
        rows.append((r.choice(["hot"] * 8 + ["a", "b", None]), us, i))
    df = spark.createDataFrame([(k, T0 + timedelta(microseconds=u), i) for k, u, i in rows], "k string, at timestamp, i int")
    start = int(T0.timestamp() * 1e6)
    got = {x["i"]: x["allowed"] for x in monitoring.multi_bucket(df, "k", "at", "i", levels, 1.0).collect()}
    assert got == loop([(k, start + u, i) for k, u, i in rows], levels, 1.0)
    assert df.columns + ["allowed"] == monitoring.multi_bucket(df.limit(0), "k", "at", "i", levels).columns


def test_effects_have_few_ranges_and_can_be_put_together():
    r = random.Random(1)
    for capacity, cost in ((1000, 300), (1000, 1), (5000, 999), (10, 20)):
        gaps = [r.choice([0, 1, 17, 250, 400]) for _ in range(400)]
        effect = monitoring.Effect(capacity, cost)
        for g in gaps:
            effect.request(g)
        assert len(effect.ranges) <= 2 * (capacity // cost + 2)
        for level in range(0, capacity + 1, max(1, capacity // 97)):
            x = level
            for g in gaps:
                x = min(capacity, x + g)
                x -= cost * (x >= cost)
            assert effect.after(level) == x


def test_a_key_of_a_million_requests_is_spread_over_tasks(spark):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000 + F.pmod(F.xxhash64("id"), F.lit(900)))
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), at.alias("at"), F.col("id"))
    done = monitoring.token_bucket(df, "k", "at", "id", 100.0, 50.0)
    parts = [x["n"] for x in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < 600_000
    us = [x["us"] for x in df.orderBy("id").select(F.unix_micros("at").alias("us")).collect()]
    level, before, allowed = 500_000, us[0], []
    for t in us:
        level = min(500_000, level + t - before)
        before = t
        allowed.append(level >= 10_000)
        level -= 10_000 * allowed[-1]
    assert [x["allowed"] for x in done.orderBy("id").select("allowed").collect()] == allowed
