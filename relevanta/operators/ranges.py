"""Sums, intervals and lookups over ordered rows without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.sources.work import staged


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the same keys that come before in an order (0 for the
    first). Rows are dealt out in ranges of keys and order; each range sums apart, and only the first key of a range goes
    on from earlier ones, so no more offsets than ranges are broadcast."""
    ranged = staged(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    sums = ranged.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).filter("_offset <> 0").drop("_sum")
    same = F.col("_o._range") == F.col("_range")
    for k in keys:
        same = same & F.col(f"_o.{k}").eqNullSafe(F.col(k))
    joined = own.join(F.broadcast(offsets.select(F.struct("_range", *keys, "_offset").alias("_o"))), same, "left")
    return joined.select(*rows.columns, (F.col(name) + F.coalesce("_o._offset", F.lit(0))).cast("long").alias(name))


def exploded(rows: DataFrame, low: Column, high: Column, name: str, block: int = 65_536) -> DataFrame:
    """A row for each number from ``low`` to ``high``, both included. Long intervals are cut into blocks that are dealt out
    first, so one row with very many numbers is no one task's."""
    cut = rows.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_high >= _low")
    cut = cut.withColumn("_block", F.explode(F.sequence(quotient(F.col("_low"), block), quotient(F.col("_high"), block))))
    cut = cut.repartition("_block", F.xxhash64(*rows.columns))
    inner = F.sequence(F.greatest("_low", F.col("_block") * block), F.least("_high", F.col("_block") * block + block - 1))
    return cut.select(*rows.columns, F.explode(inner).alias(name))


def quotient(number: Column, by: Column | int) -> Column:
    """Whole division of long numbers, rounded down, exact at any size."""
    whole, by = number.cast("long"), F.lit(by).cast("long") if isinstance(by, int) else by.cast("long")
    return F.call_function("div", whole - F.pmod(whole, by), by)


def interval_buckets(rows: DataFrame, keys: list[str], start: str, size: str) -> DataFrame:
    """``rows`` once for each bucket (``_bucket``) that their interval [start, start + size) touches. The buckets of a key are
    as wide (``_width``) as its intervals on average, so all rows together touch at most twice as many as there are."""
    rows = rows.filter(F.col(size) > 0)
    mean = F.ceil(F.sum(size) / F.count("*")).cast("long")
    if keys:
        wide = rows.join(rows.groupBy(*keys).agg(mean.alias("_width")), keys)
    else:
        wide = rows.withColumn("_width", F.lit(rows.agg(mean).first()[0] or 1).cast("long"))
    return exploded(wide, quotient(F.col(start), F.col("_width")), quotient(F.col(start) + F.col(size) - 1, F.col("_width")), "_bucket")
