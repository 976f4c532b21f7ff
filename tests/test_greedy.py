import random

import pytest

from relevanta.operators.greedy import greedy_buckets


def brute(rows, threshold):
    out = set()
    for key in {k for k, _ in rows}:
        values, head, number = sorted({v for k, v in rows if k == key and v is not None}, reverse=True), None, -1
        for v in values:
            if head is None or not head - v <= threshold:
                head, number = v, number + 1
            out.add((key, v, head, number))
    return out


def got(df):
    return {(r["k"], r["value"], r["head"], r["bucket"]) for r in df.collect()}


@pytest.fixture(params=[False, True], ids=["one range", "many ranges"])
def ranges(spark, request):
    """Small inputs fall into one range unless Spark may not coalesce."""
    if request.param:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("threshold", [0.0, 0.003, 0.1, 0.7, 1e9])
def test_buckets_over_ranges(spark, ranges, threshold):
    rng = random.Random(threshold)
    rows = [("hot", rng.random() ** 3) for _ in range(700)] + [("grid", i / 64) for i in range(300)] + [(f"k{i % 5}", rng.random()) for i in range(60)]
    rows += [("hot", None), ("none", None), (None, 0.25), (None, 0.5), ("inf", float("inf")), ("inf", 1.0), ("gap", 1.0), ("gap", -5e8), ("gap", -1e300)]
    out = greedy_buckets(spark.createDataFrame(rows, "k string, value double").repartition(5), ["k"], threshold)
    assert got(out) == brute(rows, threshold)


def test_no_values(spark):
    assert greedy_buckets(spark.createDataFrame([("a", None)], "k string, value double"), ["k"], 0.1).count() == 0
