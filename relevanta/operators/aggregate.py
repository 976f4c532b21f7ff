"""Aggregates of metric rows by tag, parameter setting and metric.

A row has a ``value`` or ``reasons``. Successes average by weight; failures are counted and never weighted. Aggregated
rows can be merged again, so partial results of several runs add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevanta.operators.patterns import matching

KEYS = ["tag", "params_key", "metric"]
COUNTS = ("success_count", "weighted_success_count", "fail_count")


def to_metric_value(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Each row as an aggregate of one sample: ``fail_count, success_count, weighted_success_count``."""
    failed = F.size("reasons") > 0
    return rows.withColumns({"fail_count": failed.cast("long"), "success_count": (~failed).cast("long"), "weighted_success_count": F.when(failed, F.lit(0.0)).otherwise(F.lit(1.0) if weight is None else weight.cast("double"))})


def aggregate_metrics(rows: DataFrame, keys: list[str] = KEYS, weight: Column | None = None, reasons: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """``keys, value, success_count, weighted_success_count, fail_count``: the weighted mean over successes, 0 without.

    With ``reasons`` also ``weighted_fail_count`` (failures are never weighted) and ``fail_reasons``, how often each reason
    failed a sample. ``more`` are aggregates of the caller's own over the rows and their counts, by name.
    """
    one = to_metric_value(rows, weight)
    if reasons and not more:
        # a row stands once for each of its reasons; its first stands for the row
        each = one.select(*keys, "value", *COUNTS, F.posexplode_outer("reasons").alias("_at", "reason"))
        is_row = F.coalesce(F.col("_at") == 0, F.lit(True))
        weighed = F.sum(F.when(is_row, F.col("weighted_success_count") * F.col("value"))).alias("_weighed")
        by_reason = each.groupBy(*keys, "reason").agg(weighed, *(F.sum(F.when(is_row, F.col(c))).alias(c) for c in COUNTS), F.count("reason").alias("n"))
        return _over_reasons(by_reason, keys)
    out = one.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("weighted_success_count") * F.col("value")), F.sum("weighted_success_count")), F.lit(0.0)).alias("value"),
        F.sum("success_count").alias("success_count"),
        F.sum("weighted_success_count").alias("weighted_success_count"),
        F.sum("fail_count").alias("fail_count"),
        *(column.alias(name) for name, column in (more or {}).items()),
    )
    return with_reasons(out, agg_fail_reasons(rows, keys), keys) if reasons else out


def _over_reasons(by_reason: DataFrame, keys: list[str]) -> DataFrame:
    """The aggregate of sums by keys and reason (null: none), ``_weighed``, counts and ``n`` samples with the reason."""
    named = F.collect_list(F.when(F.col("reason").isNotNull() & (F.col("n") > 0), F.struct("reason", "n")))
    sums = by_reason.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("_weighed"), F.sum("weighted_success_count")), F.lit(0.0)).alias("value"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS),
        F.map_from_entries(F.array_sort(named)).alias("fail_reasons"),
    )
    return sums.select(*keys, "value", "success_count", "weighted_success_count", "fail_count", F.col("fail_count").cast("double").alias("weighted_fail_count"), "fail_reasons")


def with_reasons(aggregated: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``aggregated`` with ``weighted_fail_count`` and ``fail_reasons`` of ``counts(keys, reason, n)``."""
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("fail_reasons"))
    none = F.create_map().cast("map<string,bigint>")
    return aggregated.join(maps, keys, "left").withColumns({"weighted_fail_count": F.col("fail_count").cast("double"), "fail_reasons": F.coalesce("fail_reasons", none)})


def aggregate_typed(rows: DataFrame, keys: list[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """Rows of all types at once, each by the type of its metric: means of numbers, sums of maps and nested maps by key
    (by weight where the type says so) or weighted means by key, the first sequence that isn't empty by ``seq``. ``rows`` have ``agg_type``,
    ``value``, ``map_value``, ``nested_value``, ``seq_value``, ``seq`` and ``reasons``; the result is long rows."""
    one = to_metric_value(rows, weight)
    keys = [*keys, "agg_type"]
    counts = aggregate_metrics(rows, keys, weight, reasons=True)
    counts = counts.withColumn("value", F.when(F.col("agg_type") == "DOUBLE_AVG", F.col("value")))
    entry = lambda k, p, v: F.struct(k.cast("string").alias("key"), p.cast("string").alias("position"), v.alias("v"))
    flat = F.transform(F.map_entries("map_value"), lambda e: entry(e["key"], F.lit(None), e["value"]))
    nested = F.flatten(F.transform(F.map_entries("nested_value"), lambda e: F.transform(F.map_entries(e["value"]), lambda x: entry(e["key"], x["key"], x["value"]))))
    factor = F.when(F.col("agg_type").endswith("UNWEIGHTED_SUM_VALUE"), F.lit(1.0)).otherwise(F.col("weighted_success_count"))
    entries = one.filter("success_count > 0").select(*keys, factor.alias("_w"), F.explode(F.coalesce(flat, nested)).alias("e"))
    total = F.sum(F.col("_w") * F.col("e.v"))
    mean = F.coalesce(F.try_divide(total, F.sum("_w")), F.lit(0.0))  # over the rows that have the key
    sums = entries.groupBy(*keys, "e.key", "e.position").agg(F.when(F.col("agg_type") == "MAP_AVG_VALUE", mean).otherwise(total).alias("v"))
    as_map = lambda df, by, k, v, name: df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)), lambda a, b: F.when(a[k] < b[k], -1).otherwise(1))).alias(name))
    maps = as_map(sums.filter("position is null"), keys, "key", "v", "map_value")
    inner = as_map(sums.filter("position is not null"), [*keys, "key"], "position", "v", "inner")
    first = agg_keep_first(one.filter("success_count > 0 and seq_value is not null"), keys, "seq_value", "seq")
    for part in (maps, as_map(inner, keys, "key", "inner", "nested_value"), first):
        counts = counts.join(part, keys, "left")
    return counts


def aggregate_salted(rows: DataFrame, keys: list[str] = KEYS, salts: int = 32, weight: Column | None = None) -> DataFrame:
    """The same in two steps over a salt, for values that map-side sums can't shrink enough before a hot tag's shuffle."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*keys, "value", F.monotonically_increasing_id()), F.lit(salts)))
    return merge_aggregates(aggregate_metrics(salted, [*keys, "_salt"], weight), keys)


def merge_aggregates(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Aggregates of aggregates: means by weight, counts added, fail reasons too where the rows have them."""
    weighed = F.col("value") * F.col("weighted_success_count")
    if "fail_reasons" in rows.columns:
        each = rows.select(*keys, weighed.alias("_weighed"), *COUNTS, F.posexplode_outer("fail_reasons").alias("_at", "reason", "_n"))
        is_row = F.coalesce(F.col("_at") == 0, F.lit(True))
        return _over_reasons(each.groupBy(*keys, "reason").agg(*(F.sum(F.when(is_row, F.col(c))).alias(c) for c in ("_weighed", *COUNTS)), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")), keys)
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(weighed), F.sum("weighted_success_count")), F.lit(0.0)).alias("value"), *(F.sum(c).alias(c) for c in COUNTS))


def apply_weight(rows: DataFrame, weight: Column) -> DataFrame:
    """Success weights times ``weight``; counts and failures stay."""
    return rows.withColumn("weighted_success_count", F.col("weighted_success_count") * weight)


def weight_lookup(rows: DataFrame, weights: DataFrame, key: Column, default: float = 1.0) -> DataFrame:
    """``rows`` with ``weight`` of ``weights(key, weight)``, a default where there is none."""
    table = weights.groupBy("key").agg(F.max("weight").alias("weight"))
    return rows.withColumn("_key", key).join(table.withColumnRenamed("key", "_key"), "_key", "left").withColumn("weight", F.coalesce("weight", F.lit(default))).drop("_key")


def stripped(identifier: Column, prefix: str = "", suffix: str = "") -> Column:
    """An identifier without its prefix and suffix."""
    out = F.when(identifier.startswith(prefix), F.substr(identifier, F.lit(len(prefix) + 1))).otherwise(identifier) if prefix else identifier
    return F.when(out.endswith(suffix), F.left(out, F.length(out) - len(suffix))).otherwise(out) if suffix else out


def aggregate_all_weighted(rows: DataFrame, chosen: Column, weights: DataFrame, key: Column, tag: str = "(ALL)", default: float = 1.0) -> DataFrame:
    """Chosen tags' aggregates, weighted by tag, under one tag."""
    weighted = weight_lookup(rows.filter(chosen), weights, key, default)
    return merge_aggregates(apply_weight(weighted, F.col("weight")).withColumn("tag", F.lit(tag)))


def aggregate_groups(rows: DataFrame, groups: DataFrame, key: Column, prefix: bool = False, pattern: bool = False) -> DataFrame:
    """Aggregates of ``groups(group, member)``; a tag counts in each of its groups, once. With ``prefix`` members are
    beginnings of tags: each tag meets them by its own beginnings, an equi-join. With ``pattern`` they are regular
    expressions that tags begin with, all tried in one pass a different tag (``patterns``)."""
    members = groups.select("group", "member").distinct()
    keyed = rows.withColumn("_key", key)
    if pattern:
        pairs = matching(keyed, "_key", members, "member").join(members.withColumnRenamed("member", "pattern"), "pattern")
        joined = keyed.join(pairs.select(F.col("tag").alias("_key"), "group").distinct(), "_key")
    elif prefix:
        tags = keyed.select("_key").distinct().filter(F.length("_key") > 0)
        starts = tags.select("_key", F.explode(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.left(F.col("_key"), n))).alias("member"))
        pairs = starts.join(members, "member").select("_key", "group").distinct()
        joined = keyed.join(pairs, "_key")
    else:
        joined = keyed.join(members.withColumnRenamed("member", "_key"), "_key")
    return merge_aggregates(joined, ["group", "params_key", "metric"])


def agg_fail_reasons(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, reason, n``: how often each reason failed a sample."""
    return rows.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def agg_keep_first(rows: DataFrame, keys: list[str], seq_col: str, order_col: str) -> DataFrame:
    """The first sequence that isn't empty, by an order of its own."""
    return rows.filter(F.size(seq_col) > 0).groupBy(*keys).agg(F.min_by(seq_col, order_col).alias(seq_col))


def agg_map_sum(rows: DataFrame, keys: list[str], map_col: str, weight: Column | None = None) -> DataFrame:
    """``keys, key, value``: the (weighted) sum of each key of map values, long."""
    parts = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.explode(map_col).alias("key", "_v"))
    return parts.groupBy(*keys, "key").agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))


def agg_map_avg(rows: DataFrame, keys: list[str], map_col: str, weight: Column | None = None) -> DataFrame:
    """``keys, key, value``: the weighted mean of each key over the rows that have it."""
    parts = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.explode(map_col).alias("key", "_v"))
    return parts.groupBy(*keys, "key").agg(F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")), F.lit(0.0)).alias("value"))


def agg_nested_map_sum(rows: DataFrame, keys: list[str], map_col: str, weight: Column | None = None) -> DataFrame:
    """``keys, key, position, value``: the (weighted) sum of each entry of nested maps, long."""
    parts = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.explode(map_col).alias("key", "_inner"))
    parts = parts.select(*keys, "_w", "key", F.explode("_inner").alias("position", "_v"))
    return parts.groupBy(*keys, "key", "position").agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))


def to_map(long: DataFrame, keys: list[str], key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Long sums as one map a group."""
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key_col, value_col)))).alias("map_value"))


def row_counts(rows: DataFrame, keys: list[str], record_key: list[str]) -> DataFrame:
    """``keys, successes, failures`` by record: one with any successful metric is a success."""
    records = rows.groupBy(*keys, *record_key).agg(F.bool_or(F.size("reasons") == 0).alias("_ok"))
    return records.groupBy(*keys).agg(F.count_if("_ok").alias("successes"), F.count_if(~F.col("_ok")).alias("failures"))


def agg_running_avg(rows: DataFrame, value_col: str, keys: list[str] | None = None) -> DataFrame:
    """Mean and count, by key or over all."""
    return rows.groupBy(*(keys or [])).agg(F.avg(value_col).alias("value"), F.count(value_col).alias("n"))


def agg_count(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def merge_metric_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of two row sets of the same requests in one; a metric in both is merged."""
    return merge_aggregates(left.unionByName(right), keys)
