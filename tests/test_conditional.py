import itertools
import random

import pytest
from pyspark.sql import functions as F

from relevanta.operators import conditional, ranges

MAPPED = "key string, pos long, value string"


def brute(keys, mappings, key_col):
    """Every combination in order, a dict each."""
    tables = {name: table for name, table, _ in mappings}
    children = {c: [n for n, _, p in mappings if p == c] for c in [key_col, *tables]}

    def below(name, value):
        branches = []
        for c in children[name]:
            rows = sorted((pos, v) for k, pos, v in tables[c] if k == value)
            branches.append([{c: v, **x} for _, v in rows for x in below(c, v)])
        return [{k: v for part in reversed(picked) for k, v in part.items()} for picked in itertools.product(*reversed(branches))]

    return [{key_col: v, **x} for _, v in sorted(keys) for x in below(key_col, v)]


def random_tables(seed):
    rng = random.Random(seed)
    keys = [(i, f"k{i}") for i in range(8)]
    a = [(f"k{rng.choice([1, 1, 1, 2, 4, 5, 7])}", i, f"a{i}") for i in range(40)]  # k1 is hot, some keys have none
    b = [(f"a{rng.randrange(40)}", rng.randrange(5), f"b{i}") for i in range(60)]
    c = [(f"k{i}", j, f"c{j}") for i in range(8) for j in range(rng.randrange(4))]
    return keys, [("a", a, "key"), ("b", b, "a"), ("c", c, "key")]


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_of_a_ragged_grid(spark, seed):
    keys, mappings = random_tables(seed)
    expected = brute(keys, mappings, "key")
    frames = [(n, spark.createDataFrame(t, MAPPED), p) for n, t, p in mappings]
    grid = conditional.conditional_grid(spark.createDataFrame(keys, "pos long, value string"), "key", frames)
    assert grid.count() == len(expected)
    got = lambda df, by: [r.asDict() for r in df.orderBy(by).collect()]
    assert [{k: v for k, v in r.items() if k != "idx"} for r in got(grid.slice(spark), "idx")] == expected
    n = len(expected) // 2
    assert got(grid.slice(spark, n, n + 7), "idx") == [{"idx": n + i, **x} for i, x in enumerate(expected[n : n + 7])]
    assert grid.nth(spark, len(expected)).count() == 0
    batches = got(grid.batches(), "batch_nr")
    assert [expected[b["start"]]["key"] for b in batches] == [b["key"] for b in batches] == list(dict.fromkeys(x["key"] for x in expected))
    others = {"z": spark.createDataFrame([(0, "z0"), (1, "z1"), (2, "z2")], "pos long, value string")}
    product = [{"idx": i, **x, "z": z} for i, (z, x) in enumerate(itertools.product(["z0", "z1", "z2"], expected))]
    assert got(conditional.product_slice(spark, grid, others, 5, len(product) - 5), "idx") == product[5:-5]
    rows = grid.batch_rows(others)
    whole = [{"batch_nr": b["batch_nr"], "nr": i, **x, "z": z} for b in batches for i, (z, x) in enumerate(itertools.product(["z0", "z1", "z2"], expected[b["start"] : b["end"]]))]
    assert sorted(got(rows, "nr"), key=lambda r: (r["batch_nr"], r["nr"])) == whole


def test_a_grid_too_large_to_enumerate(spark):
    names = "abcdef"
    values = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.col("id").cast("string").alias("value"))
    grid = conditional.conditional_grid(spark.createDataFrame([(0, "k")], "pos long, value string"), "key", [(n, values, "key") for n in names])
    assert grid.count() == 1000**6
    at = 987_654_321_012_345_678
    row = grid.nth(spark, at).first()
    assert [int(row[n]) for n in names] == [at // 1000**i % 1000 for i in range(6)]


def test_empty_grids(spark):
    none = spark.createDataFrame([], MAPPED)
    keys = spark.createDataFrame([(0, "k"), (1, None)], "pos long, value string")
    assert conditional.conditional_grid(keys, "key", [("a", none, "key")]).slice(spark).count() == 0
    assert [r.asDict() for r in conditional.conditional_grid(keys, "key", []).slice(spark).collect()] == [{"idx": 0, "key": "k"}]
    with pytest.raises(ValueError):
        conditional.conditional_grid(keys, "key", [("b", none, "a")])


def test_prefix_sums_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i % 5) for i in range(2000)]
    before, expected = {}, set()
    for k, i, v in rows:
        expected.add((k, i, before.get(k, 0)))
        before[k] = before.get(k, 0) + v
    got = ranges.prefix_sums(spark.createDataFrame(rows, "k string, i long, v long").repartition(3), ["k"], ["i"], "v", "b")
    assert {(r["k"], r["i"], r["b"]) for r in got.collect()} == expected


def test_exploded_cuts_long_intervals(spark):
    rows = spark.createDataFrame([("a", -3, 9), ("b", 5, 4), ("c", 7, 7)], "x string, lo long, hi long")
    assert {(r["x"], r["n"]) for r in ranges.exploded(rows, F.col("lo"), F.col("hi"), "n", 4).collect()} == {("a", i) for i in range(-3, 10)} | {("c", 7)}
