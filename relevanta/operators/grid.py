"""Parameter grids: ordered values, products by index arithmetic, slices, batches, conditional values.

A value table is ``(pos BIGINT from 0, value STRING)``. A grid is never built by crossing tables: its rows are a range of
indexes, and each parameter's position is a digit of the index (the first parameter varies fastest), so any slice costs
what it holds. Values are looked up in arrays of the value lists, which a grid's caller names one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevanta.sources.work import staged


def range_values(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """``(pos, value)`` from ``start`` in steps, as many as fit."""
    n = int((end - start) / step) + 1
    return spark.range(max(0, n)).select(F.col("id").alias("pos"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("value"))


def distinct_values(values: DataFrame) -> DataFrame:
    """First occurrences of ``(pos, value)``, numbered anew."""
    firsts = values.groupBy("value").agg(F.min("pos").alias("_at"))
    return numbered(firsts, ["_at", "value"], "pos").select("pos", "value")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 0 in an order. Ranges of the order are numbered apart and written; only
    one count a range is summed up in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "numbered")
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", before.alias("_before"))
    return ranged.join(F.broadcast(sizes), "_range").select(*rows.columns, (F.col("_before") + F.col("_n") - 1).cast("long").alias(name))


def grid_size(sizes: list[int]) -> int:
    return reduce(lambda a, b: a * b, sizes, 1)


def grid_sizes(counts: list[DataFrame]) -> DataFrame:
    """The size of a grid from one-row tables ``(n)`` of its parameters' counts."""
    return reduce(lambda a, b: a.unionByName(b), counts).agg(F.product("n").cast("long").alias("n"))


def digits(index: Column, sizes: list[int]) -> list[Column]:
    """Position of each parameter in the ``index``-th combination."""
    out, stride = [], 1
    for n in sizes:
        out.append(F.pmod(F.call_function("div", index.cast("long"), F.lit(stride).cast("long")), F.lit(max(n, 1))).cast("int"))
        stride *= n
    return out


def index_of(positions: list[Column], sizes: list[int]) -> Column:
    """Index of a combination from the positions of its values."""
    out, stride = F.lit(0).cast("long"), 1
    for p, n in zip(positions, sizes, strict=True):
        out, stride = out + p.cast("long") * F.lit(stride), stride * n
    return out


def param_grid(spark: SparkSession, params: dict[str, list], start: int = 0, end: int | None = None) -> DataFrame:
    """``(idx, one column a parameter)`` of the combinations ``start`` to ``end`` (exclusive, all by default)."""
    sizes = [len(v) for v in params.values()]
    whole = grid_size(sizes)
    rows = spark.range(min(start, whole), whole if end is None else min(end, whole)).withColumnRenamed("id", "idx")
    lists = [F.array(*map(F.lit, v)) for v in params.values()]
    return rows.select("idx", *(F.element_at(v, d + 1).alias(n) for n, v, d in zip(params, lists, digits(F.col("idx"), sizes), strict=True)))


def grid_nth(spark: SparkSession, params: dict[str, list], n: int) -> DataFrame:
    return param_grid(spark, params, n, n + 1)


def table_grid(tables: dict[str, DataFrame], start: int = 0, end: int | None = None) -> DataFrame:
    """The same for value tables of any length: rows of the index range meet each table at its digit, an equi-join on
    position. Only the tables' counts are read ahead."""
    sizes = [t.count() for t in tables.values()]
    spark, whole = next(iter(tables.values())).sparkSession, grid_size(sizes)
    rows = spark.range(min(start, whole), whole if end is None else min(end, whole)).withColumnRenamed("id", "idx")
    rows = rows.select("idx", *(d.alias(f"_{i}") for i, d in enumerate(digits(F.col("idx"), sizes))))
    for i, (name, table) in enumerate(tables.items()):
        rows = rows.join(table.select(F.col("pos").cast("int").alias(f"_{i}"), F.col("value").alias(name)), f"_{i}").drop(f"_{i}")
    return rows.select("idx", *tables)


def grid_zip(tables: dict[str, DataFrame]) -> DataFrame:
    """The n-th values of all tables together, as many as the shortest has."""
    named = [t.select("pos", F.col("value").alias(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, "pos"), named)


def ordered_union(tables: list[DataFrame]) -> DataFrame:
    """Value tables one after another: ``(pos, group, value)`` with positions going on."""
    out, offset = None, 0
    for i, t in enumerate(tables):
        part = t.select((F.col("pos") + F.lit(offset)).cast("long").alias("pos"), F.lit(i).alias("group"), "value")
        out = part if out is None else out.unionByName(part)
        offset += t.count()
    return out


def grid_map(grid: DataFrame, mapped: Column, name: str = "mapped") -> DataFrame:
    """Each combination mapped by a function of its columns, under its old index."""
    return grid.select("idx", mapped.alias(name))


def grid_merge(left: DataFrame, right: DataFrame, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """The product of two value tables as one, its values merged by a function of both; the left one varies fastest."""
    return table_grid({"_left": left, "_right": right}).select(F.col("idx").alias("pos"), merge(F.col("_left"), F.col("_right")).alias("value"))


def remove_param(grid: DataFrame, sizes: dict[str, int], name: str) -> DataFrame:
    """The grid of parameters with these sizes without one of them, numbered anew in its old order: the rows at that
    parameter's first value, their index without its digit."""
    places = dict(zip(sizes, digits(F.col("idx"), list(sizes.values())), strict=True))
    others = [n for n in sizes if n != name]
    left = grid.filter(places[name] == 0)
    return left.select(index_of([places[n] for n in others], [sizes[n] for n in others]).alias("idx"), *others)


def name_value_maps(grid: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """``(idx, params MAP<name, ARRAY<value>>)`` from (column, parameter name) pairs; names may repeat."""
    names = list(dict.fromkeys(n for _, n in columns))
    values = [F.array(*(F.col(c).cast("string") for c, n in columns if n == name)) for name in names]
    return grid.select("idx", F.create_map(*(x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v))).alias("params"))


def mapped_values(keys: DataFrame, key_col: str, mappings: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Conditional values: each mapping ``(name, table(key, value), parent column)`` joins to the key or to an earlier
    mapped column. Rows whose parent has no value drop out. A chain of equi-joins; small mappings are broadcast by Spark."""
    out = keys
    for name, table, parent in mappings:
        if parent != key_col and parent not in out.columns:
            raise ValueError(f"{parent} comes after {name}")
        out = out.join(table.select(F.col("key").alias(parent), F.col("value").alias(name)), parent)
    return out


def prune_unmapped_keys(keys: DataFrame, key_col: str, tables: list[DataFrame]) -> DataFrame:
    """Keys that every mapping knows."""
    for t in tables:
        keys = keys.join(t.select(F.col("key").alias(key_col)), key_col, "left_semi")
    return keys


def key_mapped_permutations(keys: DataFrame, key_col: str, dims: dict[str, DataFrame]) -> DataFrame:
    """Per key every combination of its params, headers and bodies, as far as it has any; keys without any drop out."""
    out = keys
    for name, table in dims.items():
        out = out.join(table.select(F.col("key").alias(key_col), F.col("value").alias(name)), key_col, "left")
    return out.filter(F.coalesce(*(F.col(n).cast("string") for n in dims)).isNotNull())


def key_remap(rows: DataFrame, key_col: str, remap: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Values reached through a key to key table ``remap(key, value)``."""
    through = remap.select(F.col("key").alias(key_col), F.col("value").alias("_through"))
    return rows.join(through, key_col).join(table.select(F.col("key").alias("_through"), F.col("value").alias(name)), "_through").drop("_through")


def batch_by_param(grid: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``batch_nr`` by the order of one parameter's values; numbered on the value table, then joined."""
    numbers = values.select((F.dense_rank().over(Window.orderBy("pos")) - 1).cast("long").alias("batch_nr"), F.col("value").alias(column))
    return grid.join(numbers, column)


def batch_by_size(grid: DataFrame, size: int) -> DataFrame:
    return grid.withColumn("batch_nr", F.floor(F.col("idx") / F.lit(size)).cast("long"))


def batch_at_most(grid: DataFrame, most: int, total: int) -> DataFrame:
    """At most ``most`` batches of one size, none of them empty."""
    return batch_by_size(grid, max(1, -(-total // most)))
