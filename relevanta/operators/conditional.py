"""Grids of conditional values by rank: size, any slice and batches without enumerating what comes before.

A key parameter has values in an order; a mapping gives each value of its parent, the key or an earlier mapping, values in
an order of its own. A key's combinations are the product of its mappings' branches, where the branch of a mapping lists,
value by value, the combinations below each value; the first mapping of a parent varies fastest. Keys come one after
another. Values without any value in one of their mappings drop out, as in ``grid.mapped_values``.

Counts of combinations come bottom-up, from the last mapping to the key. Prefix sums of the counts give each value its
interval of ranks, and a rank finds its value by an equi-join on buckets of those intervals, level by level. A grid of more
than 2**63 - 1 combinations fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.operators.grid import digits, grid_size
from relevanta.operators.ranges import exploded, interval_buckets, prefix_sums, quotient
from relevanta.sources.work import staged


@dataclass
class ConditionalGrid:
    key_col: str
    #: Of each parameter its mappings, in order.
    children: dict[str, list[str]]
    #: The key's values ``pos, value, n, before`` and a total for each of its mappings.
    keys: DataFrame
    #: By parameter its values' intervals in buckets, with a total for each of their own mappings.
    buckets: dict[str, DataFrame]

    @property
    def columns(self) -> list[str]:
        return [self.key_col, *(c for c in self.buckets if c != self.key_col)]

    def size(self) -> DataFrame:
        """One row ``n``."""
        return self.keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))

    def count(self) -> int:
        return self.size().first()["n"]

    def slice(self, spark: SparkSession, start: int = 0, end: int | None = None) -> DataFrame:
        """``idx`` and a column a parameter: the combinations ``start`` to ``end`` (exclusive, all by default)."""
        whole = self.count()
        rows = spark.range(min(start, whole), whole if end is None else max(min(start, whole), min(end, whole))).withColumnRenamed("id", "idx")
        return self.at(rows, "idx").select("idx", *self.columns)

    def nth(self, spark: SparkSession, n: int) -> DataFrame:
        return self.slice(spark, n, n + 1)

    def at(self, rows: DataFrame, rank_col: str) -> DataFrame:
        """``rows`` with the combination at each rank, a column a parameter."""
        out = self._find(rows.withColumn("_rank", F.col(rank_col)), self.key_col, None)
        return out.select(*rows.columns, *self.columns)

    def _find(self, rows: DataFrame, name: str, parent: str | None) -> DataFrame:
        """Replaces ``_rank`` by the value of ``name`` there, and goes on with its mappings."""
        table, keys = self.buckets[name], ["_key"] if parent else []
        rows = rows.withColumn("_key", F.col(parent)) if parent else rows
        if keys:
            known = rows.join(table.select("_key", "_width").distinct(), "_key")
        else:
            width = table.select("_width").first()
            known = rows.withColumn("_width", F.lit(width[0] if width else 1).cast("long"))
        known = known.withColumn("_bucket", quotient(F.col("_rank"), F.col("_width"))).drop("_width")
        totals = [f"_total_{c}" for c in self.children[name]]
        intervals = table.select(*keys, "_bucket", F.struct("value", "before", "n", *totals).alias("_at"))
        found = known.join(intervals, [*keys, "_bucket"]).filter((F.col("_rank") >= F.col("_at.before")) & (F.col("_rank") < F.col("_at.before") + F.col("_at.n")))
        found = found.select(*rows.drop("_rank", "_key").columns, F.col("_at.value").alias(name), (F.col("_rank") - F.col("_at.before")).alias(f"_rest_{name}"), *(F.col(f"_at.{c}") for c in totals))
        for c in self.children[name]:
            at = found.withColumns({"_rank": F.pmod(F.col(f"_rest_{name}"), F.col(f"_total_{c}")), f"_rest_{name}": quotient(F.col(f"_rest_{name}"), F.col(f"_total_{c}"))})
            found = self._find(at, c, name)
        return found

    def batches(self) -> DataFrame:
        """``batch_nr, key, start, end``: the ranks of each key that has combinations; one batch a key."""
        return self.keys.select(F.col("batch_nr"), F.col("value").alias(self.key_col), F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("end"))

    def batch_rows(self, others: dict[str, DataFrame] | None = None) -> DataFrame:
        """``batch_nr`` and a column a parameter: each key's combinations with all values of other parameters
        (value tables), whose place in a batch is ``nr``: the key's combinations vary fastest."""
        others = others or {}
        sizes = [t.count() for t in others.values()]
        rows = exploded(self.batches().drop(self.key_col), F.lit(0), (F.col("end") - F.col("start")) * grid_size(sizes) - 1, "nr")
        own = F.col("end") - F.col("start")
        outer = quotient(F.col("nr"), own)
        rows = rows.select("batch_nr", "nr", (F.col("start") + F.pmod("nr", own)).alias("_idx"), *(d.alias(f"_{i}") for i, d in enumerate(digits(outer, sizes))))
        return _with_values(self.at(rows, "_idx"), others).select("batch_nr", "nr", *self.columns, *others)


def _with_values(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for i, (name, table) in enumerate(tables.items()):
        rows = rows.join(table.select(F.col("pos").cast("int").alias(f"_{i}"), F.col("value").alias(name)), f"_{i}").drop(f"_{i}")
    return rows


def conditional_grid(keys: DataFrame, key_col: str, mappings: list[tuple[str, DataFrame, str]]) -> ConditionalGrid:
    """From ``keys(pos, value)`` and mappings ``(name, table(key, pos, value), parent)``."""
    children: dict[str, list[str]] = {key_col: []}
    for name, _, parent in mappings:
        if parent not in children:
            raise ValueError(f"{parent} comes after {name}")
        children[parent].append(name)
        children[name] = []
    tables = {name: table for name, table, _ in mappings}
    buckets: dict[str, DataFrame] = {}

    def counted(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with ``n`` and a total for each mapping; what lacks a mapping drops out."""
        for c in children[name]:
            totals = buckets[c].select("_key", "total").distinct()
            rows = rows.join(totals.select(F.col("_key").alias("value"), F.col("total").alias(f"_total_{c}")), "value")
        return rows.withColumn("n", reduce(lambda a, b: a * b, [F.col(f"_total_{c}") for c in children[name]], F.lit(1).cast("long")))

    for name, _, _ in reversed(mappings):
        rows = counted(tables[name].select(F.col("key").alias("_key"), "pos", "value").filter("_key is not null and value is not null"), name)
        placed = prefix_sums(rows, ["_key"], ["pos", "value"], "n", "before")
        totals = placed.groupBy("_key").agg(F.sum("n").alias("total"))
        buckets[name] = staged(interval_buckets(placed.join(totals, "_key"), ["_key"], "before", "n"), "intervals")
    top = counted(keys.select("pos", "value").filter("value is not null"), key_col)
    top = prefix_sums(prefix_sums(top, [], ["pos", "value"], "n", "before").withColumn("_one", F.lit(1)), [], ["pos", "value"], "_one", "batch_nr")
    top = staged(top.drop("_one"), "grid-keys")
    buckets = {key_col: staged(interval_buckets(top, [], "before", "n"), "intervals"), **{name: buckets[name] for name, _, _ in mappings}}
    return ConditionalGrid(key_col, children, top, buckets)


def product_slice(spark: SparkSession, conditional: ConditionalGrid, others: dict[str, DataFrame], start: int = 0, end: int | None = None) -> DataFrame:
    """``idx`` and a column a parameter of a slice of the product of a conditional grid, which varies fastest, with other
    parameters' value tables."""
    sizes = [conditional.count(), *(t.count() for t in others.values())]
    whole = grid_size(sizes)
    rows = spark.range(min(start, whole), whole if end is None else max(min(start, whole), min(end, whole))).withColumnRenamed("id", "idx")
    inner = sizes[0] or 1
    rows = rows.select("idx", F.pmod("idx", F.lit(inner)).alias("_rank_in"), *(d.alias(f"_{i}") for i, d in enumerate(digits(quotient(F.col("idx"), inner), sizes[1:]))))
    return _with_values(conditional.at(rows, "_rank_in"), others).select("idx", *conditional.columns, *others)
