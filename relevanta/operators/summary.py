"""Summaries and analysis of aggregated metric rows ``(tag, params MAP<STRING, ARRAY<STRING>>, params_key, metric, value,
success_count…)``: best and worst settings, effects of parameters, winners and losers. Every operator works on all tags
and metrics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.functions.text import params_key
from relevanta.operators.greedy import greedy_buckets
from relevanta.operators.grid import numbered, table_grid
from relevanta.operators.ranges import prefix_sums, quotient
from relevanta.sources.work import staged

GROUP = ["tag", "metric"]


def group_similar_values(rows: DataFrame, threshold: float = 0.01, keys: list[str] = GROUP) -> DataFrame:
    """``keys, bucket, bucket_value, params_key, value``: values in descending order fall into buckets; a row joins while
    it is within ``threshold`` of its bucket's first value. Each group's different values are folded range by range
    (``greedy_buckets``); each row then finds its own. Rows without a value drop out."""
    heads = greedy_buckets(rows, keys, threshold).withColumnsRenamed({k: f"_{k}" for k in keys} | {"value": "_value"})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("value").cast("double") == F.col("_value")]
    found = rows.filter("value is not null").select(*keys, "params_key", "value").join(heads, same)
    return found.select(*keys, F.col("bucket").cast("int").alias("bucket"), F.col("head").alias("bucket_value"), "params_key", "value")


def tie_break_score(params: Column, per_param: float = 1000.0, per_unit: float = 1.0) -> Column:
    """Numeric single-valued parameters that aren't 0 cost a fixed price each and their value; the cheapest wins."""
    numbers = F.filter(F.transform(F.map_values(params), lambda v: F.when(F.size(v) == 1, v[0].try_cast("double"))), lambda x: F.abs(x) >= 1e-5)
    return F.size(numbers) * F.lit(per_param) + F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) * per_unit


def best_worst_config(rows: DataFrame, threshold: float = 0.01, keys: list[str] = GROUP) -> DataFrame:
    """``keys, kind, params_key, value``: the cheapest setting of the first and of the last bucket with the bucket's first
    value; settings without a success take no part."""
    live = rows.filter(F.col("success_count") > 0)
    scored = live.select(*keys, "params_key", tie_break_score(F.col("params")).alias("_score"))
    bucketed = group_similar_values(live, threshold, keys).join(scored, [*keys, "params_key"])
    ends = bucketed.groupBy(*keys).agg(F.max("bucket").alias("_last"))
    cheapest = Window.partitionBy(*keys, "bucket").orderBy("_score", "params_key")
    picked = bucketed.withColumn("_n", F.row_number().over(cheapest)).filter("_n = 1").join(ends, keys)
    kinds = F.explode(F.filter(F.array(F.when(F.col("bucket") == 0, "best"), F.when(F.col("bucket") == F.col("_last"), "worst")), lambda k: k.isNotNull()))
    return picked.select(*keys, kinds.alias("kind"), "params_key", F.col("bucket_value").alias("value"))


def _by_param(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "params", "value", F.explode(F.map_keys("params")).alias("param")).withColumn("setting", F.array_join(F.array_sort(F.element_at("params", F.col("param"))), "&"))


def max_median_shift(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """``keys, param, median_shift``: how far apart the medians of a parameter's values lie."""
    medians = exact_medians(_by_param(rows.filter(F.col("success_count") > 0), keys), [*keys, "param", "setting"], "value")
    return medians.groupBy(*keys, "param").agg((F.max("median") - F.min("median")).alias("median_shift"))


def exact_medians(rows: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """``keys, median``: the middle value, or the mean of the two middle ones; nulls don't count. Equal values are counted
    first, then each different one finds its ranks by prefix sums over ranges of the order: no task and no row holds a
    group, however large."""
    counts = rows.filter(F.col(value_col).isNotNull()).groupBy(*keys, F.col(value_col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = prefix_sums(counts, keys, ["_v"], "_n", "_before")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    low, high = quotient(F.col("_all") - 1, 2), quotient(F.col("_all"), 2)  # the middle ranks, from 0
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    same = [placed[k].eqNullSafe(sizes[k]) for k in keys]
    middle = placed.join(sizes, same).select(*(placed[k] for k in keys), "_v", holds(low).alias("_low"), holds(high).alias("_high")).filter("_low or _high")
    return middle.groupBy(*keys).agg(((F.max(F.when(F.col("_low"), F.col("_v"))) + F.max(F.when(F.col("_high"), F.col("_v")))) / 2).alias("median"))


def max_single_result_shift(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """``keys, param, single_shift``: the largest spread of the metric among settings equal in all other parameters."""
    live = rows.filter((F.col("success_count") > 0) & (F.col("value") >= 0))
    named = live.select(*keys, F.explode(F.map_keys("params")).alias("param")).distinct()
    each = live.join(named, keys).withColumn("_rest", params_key(F.map_filter("params", lambda k, _: k != F.col("param"))))
    spread = each.groupBy(*keys, "param", "_rest").agg((F.max("value") - F.min("value")).alias("d"))
    return spread.groupBy(*keys, "param").agg(F.max("d").alias("single_shift"))


def run_summary(rows: DataFrame, threshold: float = 0.01, keys: list[str] = GROUP) -> DataFrame:
    """One row a tag and metric: best and worst setting, their values, and both effects as maps by parameter. The rows, few
    as they are aggregates, are written once and then summarised in three ways."""
    rows = staged(rows, "summary-rows")
    ends = best_worst_config(rows, threshold, keys).groupBy(*keys)
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    ends = ends.agg(pick("best", "params_key").alias("best"), pick("best", "value").alias("best_value"), pick("worst", "params_key").alias("worst"), pick("worst", "value").alias("worst_value"))
    as_map = lambda df, c: df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", c)))).alias(c))
    return ends.join(as_map(max_median_shift(rows, keys), "median_shift"), keys, "left").join(as_map(max_single_result_shift(rows, keys), "single_shift"), keys, "left")


def summary_effect_matrix(summary: DataFrame, params: list[str], keys: list[str] = GROUP) -> DataFrame:
    """``keys, measure`` and a column a parameter with four decimals."""
    rows = [summary.select(*keys, F.lit(m).alias("measure"), *(F.format_string("%.4f", F.try_element_at(m, F.lit(p))).alias(p) for p in params)) for m in ("median_shift", "single_shift")]
    return rows[0].unionByName(rows[1])


def summary_winner_loser(summary: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """A winner and a loser row a tag and metric: setting and value."""
    return summary.select(*keys, F.explode(F.array(F.struct(F.lit("winner").alias("kind"), F.col("best").alias("params_key"), F.col("best_value").alias("value")), F.struct(F.lit("loser").alias("kind"), F.col("worst").alias("params_key"), F.col("worst_value").alias("value")))).alias("_x")).select(*keys, "_x.kind", "_x.params_key", "_x.value")


def improving_losing(rows: DataFrame, current_key: str, query_col: str = "tag") -> DataFrame:
    """``query, metric, params_key, change``: each setting's value less the one of the current setting."""
    now = F.max(F.when(F.col("params_key") == current_key, F.col("value"))).over(Window.partitionBy(query_col, "metric"))
    compared = rows.select(query_col, "metric", "params_key", (F.col("value") - now).alias("change"), now.isNotNull().alias("_known"))
    return compared.filter(F.col("_known") & (F.col("params_key") != current_key)).drop("_known")


def uncompared_queries(rows: DataFrame, current_key: str, query_col: str = "tag") -> DataFrame:
    """``query, reason``: queries that lack the current setting, or any other."""
    flags = rows.groupBy(query_col).agg(F.bool_or(F.col("params_key") == current_key).alias("now"), F.bool_or(F.col("params_key") != current_key).alias("other"))
    return flags.filter(~(F.col("now") & F.col("other"))).select(query_col, F.when(~F.col("now"), "NO_CURRENT_VALUE").otherwise("NO_COMPARISON_VALUE").alias("reason"))


def top_bottom_per_setting(rows: DataFrame, n: int, k: int, value_col: str = "change", by: list[str] | None = None, tie_col: str = "tag") -> DataFrame:
    """The ``n`` highest and ``k`` lowest rows of each setting, ``kind`` and ``rank`` added. The rows are written once; each
    end is a window with a limit of its own, so that a task passes on no more than ``n`` and ``k`` rows of a setting (up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``)."""
    by = by or ["metric", "params_key"]
    rows = staged(rows, "ranked")

    def end(order: Column, most: int, kind: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order, tie_col))
        return rows.withColumn("rank", place).filter(F.col("rank") <= most).withColumn("kind", F.lit(kind))

    return end(F.desc(value_col), n, "best").unionByName(end(F.asc(value_col), k, "worst"))


def query_metric_variance(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Population variance of a metric over the settings of each query, ascending."""
    return rows.groupBy(*keys).agg(F.var_pop("value").alias("variance"), F.count("*").alias("settings")).orderBy("variance", *keys)


def sort_by_metric(rows: DataFrame, metric: str, n: int, worst: bool = False) -> DataFrame:
    """The ``n`` rows with the highest (or lowest) value of a metric; fails if no row has the metric."""
    own = rows.filter(F.col("metric") == metric)
    if own.isEmpty():
        raise ValueError(f"no rows of metric {metric}")
    return own.orderBy(F.asc("value") if worst else F.desc("value"), "tag", "params_key").limit(n)


def select_params_metrics(wide: DataFrame, params: list[str]) -> DataFrame:
    """Parameter columns and ``value-`` columns of a wide result table."""
    return wide.select(*params, *(F.col(f"`{c}`") for c in wide.columns if c.startswith("value-")))


def histogram_series(long: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Counts by position of one value, positions as numbers, ascending."""
    return long.filter(F.col("key") == value).select(*keys, F.col("position").cast("int").alias("position"), F.col("value").alias("n")).orderBy(*keys, "position")


def align_series(series: DataFrame, name_col: str = "series", label_col: str = "label", value_col: str = "value", most: int = 10**9) -> DataFrame:
    """Every series on the union of labels; 0.0 where it has none. The result is names times labels by definition: it fails
    above ``most`` rows, and its rows come from a range of indexes, so none of them is one task's to make."""
    names, labels = (numbered(series.select(F.col(c).alias("value")).distinct(), [F.col("value").asc_nulls_first()], "pos") for c in (name_col, label_col))
    rows = names.count() * labels.count()
    if rows > most:
        raise ValueError(f"{rows} rows of series and labels, more than {most}")
    own = series.select(F.col(name_col).alias("_name"), F.col(label_col).alias("_label"), F.col(value_col).alias("_value"))
    whole = table_grid({name_col: names, label_col: labels})
    joined = whole.join(own, F.col(name_col).eqNullSafe(F.col("_name")) & F.col(label_col).eqNullSafe(F.col("_label")), "left")
    return joined.select(name_col, label_col, F.coalesce("_value", F.lit(0.0)).alias(value_col))


def metric_series(rows: DataFrame, metric: str) -> DataFrame:
    """``label, value`` in descending order; a label is ``name__v1_v2`` of each parameter joined by ``|``."""
    entries = F.array_sort(F.map_entries("params"))
    label = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("__"), F.array_join(e["value"], "_"))), "|")
    return rows.filter(F.col("metric") == metric).select("tag", label.alias("label"), "value").orderBy(F.desc("value"), "tag", "label")
