"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a token target (weights, capped at a multiple of its size, the excess reshared). Its documents stand in
a fixed pseudo-random order; the mix takes that order again and again up to the target. A source's weight changes over
training time by a piecewise linear schedule; the schedule is integrated to a cumulative demand, and the demand inverted
at each document's place in its source's order gives its training position in [0, 1]. ``curriculum`` range-sorts by it.

The order within a source is dealt into cells by hash, so a source that holds a third of all rows is as many cells as its
rows need; the cells of a source are summed up over ranges. In the one cell of each source in which the target is reached,
documents are tried longest first, so that little of the target stays open.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are taken 0
times; the order goes by hash of id and text, so rows without an id stand all over their source; rows alike in both are
numbered by ranges and stand by their number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.llm.common import WORD, staged
from relevanta.operators.ranges import prefix_sums

#: Rows a cell of the order aims at.
CELL_ROWS = 1024
#: (time, relative weight) knots, dealt to the sources in turn: falling, level and rising weight.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a schedule has asked for ``share`` of its whole demand."""
    areas = [(a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope, need = (w1 - w0) / (t1 - t0), share * whole - done
        # need = w0 x + slope x^2 / 2, in the form that also holds for slope 0
        here = t0 + 2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))))
        done += area
        out = F.when(share * whole <= done, here) if out is None else out.when(share * whole <= done, here)
    return F.least(F.greatest(out.otherwise(F.lit(knots[-1][0])), F.lit(knots[0][0])), F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(_key, source, source_size, _turn, target)`` a source.

    The level L with sum(min(cap, L * weight)) = share * all sizes is found from running sums in the order in which
    sources reach their caps. The windows hold one row a source.
    """
    whole, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size")).withColumn("_turn", F.row_number().over(by_name) - 1)
    table = table.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_turn") % len(weights) + 1).cast("int")))
    table = table.withColumns({"_cap": F.col("source_size") * F.lit(float(most)), "_total": F.sum("source_size").over(whole) * F.lit(float(share)), "_w_all": F.sum("_w").over(whole)})
    full = Window.orderBy(F.col("_cap") / F.col("_w"), "_turn").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"_c": F.coalesce(F.sum("_cap").over(full), F.lit(0.0)), "_v": F.coalesce(F.sum("_w").over(full), F.lit(0.0))})
    table = table.withColumn("_level", (F.col("_total") - F.col("_c")) / (F.col("_w_all") - F.col("_v")))
    level = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_turn"), F.col("_level")))).over(whole)["_level"]
    return table.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_key", "source", "source_size", "_turn", "target")


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within each boundary cell, longest first, takes whatever still fits into what is left of the target."""
    key, left = None, 0.0
    for rows in batches:
        extra = []
        for k, size, room in zip(zip(rows["_key"], rows["_cell"], strict=True), rows["size"], rows["_room"], strict=True):
            if k != key:
                key, left = k, room
            extra.append(int(0 < size <= left))
            left -= size * extra[-1]
        yield rows.assign(_extra=extra)


def order_places(sized: DataFrame, seed: int) -> DataFrame:
    """Rows ``doc_id, size, _h`` (the text's hash) and ``row`` with ``_u`` in [0, 1], their place in the order: by id and
    text, and for rows alike in both by their number among them, which ranges of the rows count apart."""
    alike = ["doc_id", "_h"]
    copies = staged(sized.filter("size > 0").groupBy(*alike).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "copies")
    numbered = sized.withColumn("_copy", F.lit(0).cast("long"))
    if not copies.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_of_h"))
        repeated = sized.filter("size > 0").join(copies.toDF("_of", "_of_h"), same, "left_semi").select(*alike, "row", F.lit(1).alias("_one"))
        numbers = prefix_sums(repeated, alike, ["row"], "_one", "_copy").select("row", "_copy")
        numbered = sized.join(numbers, "row", "left").withColumn("_copy", F.coalesce("_copy", F.lit(0)))
    # documents of size 0 are never taken: wherever they stand, the mix is the same
    u = F.xxhash64("doc_id", "_h", F.when(F.col("size") == 0, F.col("row")), F.when(F.col("_copy") > 0, F.col("_copy")), F.lit(seed))
    return staged(numbered.withColumn("_u", u.cast("double") / F.lit(2.0**64) + 0.5).drop("_h", "_copy"), "sized")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: ``row, doc_id, source, size, source_size, target, repeats, taken, positions``.

    ``row`` numbers the rows. Size is the number of words. ``repeats`` is how often the mix takes the document, ``taken`` its words with repeats and
    ``positions`` the training time of each repeat.
    """
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("_key"), size.alias("size"), F.xxhash64(text_col).alias("_h"), F.monotonically_increasing_id().alias("row"))
    sized = order_places(staged(sized, "counted"), seed)
    cells = max(1, -(-sized.count() // CELL_ROWS))
    sized = sized.withColumn("_cell", F.least(F.floor(F.col("_u") * cells), F.lit(cells - 1)).cast("long"))

    sums = sized.groupBy("_key", "source", "_cell").agg(F.sum("size").alias("size"))
    sums = prefix_sums(sums, ["_key"], ["_cell"], "size", "_before")
    targets = source_targets(sized, weights, share, most)
    # whole rounds of the source first, then the order once more up to _part
    table = sums.join(targets.drop("source"), "_key").withColumn("_rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    table = table.withColumn("_room", F.col("target") - F.col("_rounds") * F.col("source_size") - F.col("_before"))
    state = F.when(F.col("_room") >= F.col("size"), 1).when(F.col("_room") <= 0, 0).otherwise(2)
    table = table.select("_key", "_cell", "_before", "source_size", "target", "_turn", "_rounds", "_room", state.alias("_state"))

    rows = sized.join(table, ["_key", "_cell"])
    within = Window.partitionBy("_key", "_cell").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("_extra", F.col("_state"))
    edge = rows.filter("_state = 2").repartition("_key", "_cell").sortWithinPartitions("_key", "_cell", F.desc("size"), "_u", "doc_id")
    rows = rows.filter("_state <> 2").unionByName(edge.mapInPandas(_fill, rows.schema))

    repeats = F.when(F.col("size") > 0, F.col("_rounds") + F.col("_extra")).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumns({"repeats": repeats, "taken": (repeats * F.col("size")).cast("long")})

    def position(e: Column) -> Column:
        share_ = F.least((e * F.col("source_size") + F.col("_at")) / F.col("target"), F.lit(1.0))
        out = None
        for k, knots in enumerate(schedules):
            here = invert_demand(share_, knots)
            out = F.when(F.col("_turn") % len(schedules) == k, here) if out is None else out.when(F.col("_turn") % len(schedules) == k, here)
        return out

    none = F.array().cast("array<double>")
    rows = rows.withColumn("positions", F.when(F.col("repeats") > 0, F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), position)).otherwise(none))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", "repeats", "taken", "positions")


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row a taken repeat, range-sorted by training position."""
    order = ["position", "source", "doc_id", "row"]
    return mixed.select("row", "doc_id", "source", "size", F.posexplode("positions").alias("repeat", "position")).repartitionByRange(*order).sortWithinPartitions(*order)


def mixing_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: what the written curriculum takes of each document."""
    mixed = staged(mix(docs), "mixed")
    taken = staged(curriculum(mixed), "curriculum").groupBy("row").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    rows = mixed.select("row", "doc_id", "size", "source_size", "target").join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_position")
