"""Greedy buckets of similar values over ranges, so that no row and no task holds a group.

Values of a group fall, in descending order, into buckets: a value joins while it is within ``threshold`` of its bucket's
first value, the head. Where a range of the order begins depends on the head before it, but only values within a threshold
below the range before can be the first new head. Each range therefore folds alone from each of those, and keeps the last
head of each fold, its exits. An exit leads to one exit of a later range; the exits that the group's first value reaches are
found by pointer jumping, in rounds that grow with the logarithm of the number of ranges. Then each range knows the head it
begins under and labels its own values.

Groups inside one range need none of this. Pieces of groups over several ranges are at most two a range, so what is known
of them by piece is bounded by the number of ranges and broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from relevanta.sources.work import staged


def _apart(head: float, value: float, threshold: float) -> bool:
    return not (head - value <= threshold)


def _folds(values: list[float], threshold: float) -> list[int]:
    """For each value the last head of the fold that begins with it."""
    n = len(values)
    after, j = [n] * n, 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and not _apart(values[i], values[j], threshold):
            j += 1
        after[i] = j
    last = list(range(n))
    for i in reversed(range(n)):
        if after[i] < n:
            last[i] = last[after[i]]
    return last


def _first_apart(values: list[float], head: float, threshold: float) -> int:
    """The first value that a head does not take; ``len(values)`` if it takes all."""
    low, high = 0, len(values)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _apart(head, values[mid], threshold) else (mid + 1, high)
    return low


def _pieces(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first ``by`` columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[:by])


def _written(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _mapped(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], result: StructType) -> DataFrame:
    schema = to_arrow_schema(result)
    return rows.mapInArrow(lambda batches: _written(make(batches), schema), result)


def greedy_buckets(values: DataFrame, keys: list[str], threshold: float, value_col: str = "value") -> DataFrame:
    """``keys, value, head, bucket`` of every different value that isn't null; buckets count from 0 in descending order."""
    spark = values.sparkSession
    different = values.select(*keys, F.col(value_col).cast("double").alias("value")).filter("value is not null").distinct()
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col("value").desc()]
    ranged = staged(different.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "greedy-values")
    key_types = [different.schema[k] for k in keys]
    by = ["_range", *keys]

    # pieces of groups over several ranges: at most two a range
    bounds = ranged.groupBy(*by).agg(F.max("value").alias("first"), F.min("value").alias("last"))
    bounds = bounds.withColumn("_ranges", F.count("*").over(Window.partitionBy(*keys))).filter("_ranges > 1").collect()
    pieces: dict[tuple, list[tuple]] = {}
    for r in bounds:
        pieces.setdefault(tuple(r[k] for k in keys), []).append((r["_range"], r["first"], r["last"]))
    for own in pieces.values():
        own.sort()
    known = spark.sparkContext.broadcast(pieces)
    incoming = _incoming(ranged, keys, key_types, pieces, known, threshold) if pieces else {}
    heads_before = spark.sparkContext.broadcast(incoming)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (range_, *key), rows in _pieces(batches, 1 + len(keys)):
            head, start = heads_before.value.get((range_, tuple(key)), (None, None))
            number = -1
            for *_, value in rows:
                # under the head from before until the value that is known to begin a bucket
                if head is None or (_apart(head, value, threshold) if number >= 0 else value == start or (value != value and start != start)):
                    head, number = value, number + 1
                yield (range_, *key, value, head, number)

    result = StructType([ranged.schema["_range"], *key_types, ranged.schema["value"]]).add("head", "double").add("_n", "long")
    ordered = ranged.select(*by, "value").repartition(*by).sortWithinPartitions("_range", *order)
    labelled = staged(_mapped(ordered, label, result), "greedy-labels")
    counts = labelled.groupBy(*by).agg((F.max("_n") + 1).alias("_heads"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # only pieces of groups over several ranges go on from earlier ones: at most two a range
    offsets = counts.withColumn("_offset", F.sum("_heads").over(earlier)).filter("_offset is not null").select(F.struct(*by, "_offset").alias("_o"))
    same = F.col("_range") == F.col("_o._range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o.{k}"))
    return labelled.join(F.broadcast(offsets), same, "left").select(*keys, "value", "head", (F.col("_n") + F.coalesce("_o._offset", F.lit(0))).alias("bucket"))


def _incoming(ranged: DataFrame, keys: list[str], key_types: list, pieces: dict, known, threshold: float) -> dict:
    """By range and key of every piece but a group's first: the head before it, and the value that begins its first own
    bucket (None if the head takes all). At most two a range."""
    spark, by = ranged.sparkSession, ["_range", *keys]
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col("value").desc()]

    def place(key: tuple, range_: int) -> int:
        return [p[0] for p in known.value[key]].index(range_)

    def next_range(key: tuple, at: int, exit_: float) -> int | None:
        """The range of the first value that an exit of the group's piece ``at`` does not take."""
        return next((r for r, _, last in known.value[key][at + 1 :] if _apart(exit_, last, threshold)), None)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (range_, *key), rows in _pieces(batches, 1 + len(keys)):
            key = tuple(key)
            if key not in known.value:
                continue
            values, at = [row[-1] for row in rows], place(key, range_)
            last = _folds(values, threshold)
            # the first values that can begin a bucket here, whatever the head before
            most = 0 if at == 0 else min(len(values) - 1, _first_apart(values, known.value[key][at - 1][2], threshold))
            for i in sorted({last[i] for i in range(most + 1)}):
                goal = next_range(key, at, values[i])
                if goal is not None or at == 0:
                    yield (-1 if goal is None else goal, *key, values[i], range_, at == 0)

    result = StructType([ranged.schema["_range"], *key_types, ranged.schema["value"]]).add("_from", "integer").add("_start", "boolean")
    ordered = ranged.select(*by, "value").repartition(*by).sortWithinPartitions("_range", *order)
    out = staged(_mapped(ordered, exits, result), "greedy-exits")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (range_, *key), rows in _pieces(batches, 1 + len(keys)):
            values, last = [], None
            for *_, value, from_, start, is_exit in rows:
                if not is_exit:
                    values.append(value)
                    continue
                last = last or _folds(values, threshold)
                j = _first_apart(values, value, threshold)
                yield (range_, *key, value, from_, start, values[j], values[last[j]])

    both = ranged.select(*by, "value", F.lit(None).cast("int").alias("_from"), F.lit(None).cast("boolean").alias("_start"), F.lit(False).alias("_exit")).unionByName(out.filter("_range >= 0").withColumn("_exit", F.lit(True)))
    both = both.repartition(*by).sortWithinPartitions("_range", *(F.col(k).asc_nulls_first() for k in keys), "_exit", F.col("value").desc())
    result = StructType([*result.fields]).add("_begins", "double").add("_next", "double")
    leads = staged(_mapped(both, lead, result), "greedy-leads")  # _range is where an exit leads

    # the exits that a group's start reaches, twice as far each round
    def joined(rows: DataFrame, on: str, other: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with ``_to`` of ``other(keys, _via, _to)`` where ``on`` is ``_via``."""
        other = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_via", "_to")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return rows.join(other, [*same, F.col(on) == F.col("_via")], how)

    reached = leads.filter("_start").select(*keys, "value")
    hops = leads.select(*keys, F.col("value").alias("_via"), F.col("_next").alias("_to"))
    for _ in range((max(map(len, pieces.values())) - 1).bit_length()):
        further = joined(reached, "value", hops).select(*keys, F.col("_to").alias("value"))
        reached = staged(reached.unionByName(further).distinct(), "greedy-reached")
        twice = joined(hops.withColumnsRenamed({"_via": "_from", "_to": "_over"}), "_over", hops)
        hops = staged(twice.select(*keys, F.col("_from").alias("_via"), "_to"), "greedy-hops")
    marks = reached.select(*keys, F.col("value").alias("_via"), F.lit(True).alias("_to"))
    found = joined(leads, "value", marks, "left_semi").collect()  # one a piece at most
    incoming: dict = {}
    for r in found:
        key = tuple(r[k] for k in keys)
        ranges = [p[0] for p in pieces[key]]
        for range_ in ranges[ranges.index(r["_from"]) + 1 : ranges.index(r["_range"]) + 1]:
            incoming[range_, key] = (r["value"], r["_begins"] if range_ == r["_range"] else None)
    # beyond the last exit that leads anywhere a group is under the head where that one led, or under its first exit
    last = {tuple(r[k] for k in keys): r["value"] for r in out.filter("_start").collect()}  # one a group of several ranges
    for r in sorted(found, key=lambda r: r["_range"]):
        last[tuple(r[k] for k in keys)] = r["_next"]
    for key, own in pieces.items():
        for range_, _, _ in own[1:]:
            incoming.setdefault((range_, key), (last[key], None))
    return incoming
