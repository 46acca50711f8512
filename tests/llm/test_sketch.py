import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import sketch as s

SCHEMA = "key string, value double, part string, level string, items string"


def run(df, wanted, k=32, fan=4):
    return {(r["key"], r["pct"]): r for r in s.group_percentiles(df, "key", "value", wanted, k, fan).collect()}


def off(values, got, pct):
    """By how many ranks got misses the exact percentile."""
    x, rank = np.sort(values), max(1, math.ceil(pct / 100 * len(values) - 1e-9))
    lo, hi = np.searchsorted(x, got, "left") + 1, np.searchsorted(x, got, "right")
    return max(0, lo - rank, rank - hi)


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=3000), st.sampled_from([2, 4, 16]), st.sampled_from([8, 32]))
@settings(max_examples=60, deadline=None)
def test_carried_bound_holds(values, fan, k):
    a, b = s.Sketch(k, fan), s.Sketch(k, fan)
    x = np.array(values, float)
    for part in np.array_split(x, 7):
        a.add(part)
    for level, err, items in a.rows():
        b.load(level, err, items)
    rows = list(b.rows())
    items = np.concatenate([r[2] for r in rows])
    w = np.concatenate([np.full(len(r[2]), float(fan) ** max(r[0], 0)) for r in rows])
    assert w.sum() == len(x)
    bound = sum(r[1] for r in rows)
    for t in np.unique(x):
        assert abs(w[items <= t].sum() - (x <= t).sum()) <= bound


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_error_within_bound_and_known(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(20000)] + [("tied", float(rng.randrange(3))) for _ in range(3000)] + [("few", float(i)) for i in range(10)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p", "l", "i") for r in rows], SCHEMA).repartition(parts)
    got = run(df, [1.0, 25.0, 50.0, 90.0, 99.0, 100.0])
    for (key, pct), r in got.items():
        values = [v for k, v in rows if k == key]
        assert r["n"] == len(values)
        assert off(values, r["value"], pct) <= r["rank_error"]
    assert got["few", 50.0]["value"] == 4.0 and got["few", 50.0]["rank_error"] == 0
    assert got["hot", 50.0]["rank_error"] <= 0.25 * 20000


def test_default_size_is_within_half_a_percent(spark):
    df = spark.range(400_000).select(F.lit("k").alias("key"), (F.hash("id") % 100_000).cast("double").alias("value"))
    values = np.array([r[0] for r in df.select("value").collect()])
    for r in s.group_percentiles(df, "key", "value", [5.0, 50.0, 95.0]).collect():
        assert r["rank_error"] <= 0.005 * len(values)
        assert off(values, r["value"], r["pct"]) <= r["rank_error"]


def test_days_put_together(spark):
    df = spark.range(30_000).select(F.concat(F.lit("d"), F.col("id") % 5).alias("day"), F.hash("id").cast("double").alias("value"))
    daily = s.merge_sketches(s.partial_sketches(df, "day", "value", 64, 4), 64, 64, 4)
    joined = daily.select(F.lit("all").alias("key"), F.substring("key", 2, 1).cast("bigint").alias("part"), "level", "err", "items")
    r = s.percentiles(s.merge_sketches(joined, 5, 64, 4), [50.0], 4).first()
    values = [x[0] for x in df.select("value").collect()]
    assert r["n"] == 30_000 and off(values, r["value"], 50) <= r["rank_error"] < 0.2 * 30_000


def test_same_result_every_time(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.hash("id").cast("double").alias("value")).repartition(3, "value")
    assert run(df, [50.0])["k", 50.0] == run(df, [50.0])["k", 50.0]


def test_missing_values_and_empty(spark):
    rows = [("a", None), ("a", float("nan")), (None, 1.0), ("b", 2.0), ("b", float("inf")), ("b", float("-inf"))]
    df = spark.createDataFrame([(*r, "p", "l", "i") for r in rows], SCHEMA)
    got = run(df, [1.0, 50.0, 100.0])
    assert {k for k, _ in got} == {"b"}
    assert [got["b", p]["value"] for p in (1.0, 50.0, 100.0)] == [float("-inf"), 2.0, float("inf")]
    assert run(df.where("false"), [50.0]) == {}
