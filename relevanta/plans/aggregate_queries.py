"""Queries over metric rows: tags, aggregates, weights, groups, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions import ranking, text
from relevanta.operators import aggregate as agg
from relevanta.operators import fold, tags
from relevanta.plans import tables as t
from relevanta.plans.tables import METRIC_ROWS, REQUESTS
from relevanta.sources.results import reasons_text

QUERIES, ORACLES = {}, {}
_KEYS = ["tag", "params_key", "metric"]


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("value", "weighted_success_count") if c in rows.columns})


def _agg_sql(keys: str, weight: str = "1.0", source: str = "m") -> str:
    w = f"CASE WHEN value IS NOT NULL THEN {weight} ELSE 0 END"
    return f"SELECT {keys}, round(coalesce(sum({weight} * value) / nullif(sum({w}), 0), 0), 6) AS value, count(value) AS success_count, round(sum({w}), 6)::DOUBLE AS weighted_success_count, count(*) - count(value) AS fail_count FROM {source} GROUP BY {keys}"


@register(f"WITH {METRIC_ROWS} SELECT metric, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END)::BIGINT AS fail_count, sum(CASE WHEN reason IS NULL THEN weight ELSE 0 END)::DOUBLE AS weighted_success_count FROM m GROUP BY 1")
def to_metric_value(spark: SparkSession, d: str) -> DataFrame:
    rows = agg.to_metric_value(t.metric_rows(spark, d), F.col("weight"))
    return rows.groupBy("metric").agg(*(F.sum(c).alias(c) for c in ("success_count", "fail_count", "weighted_success_count")))


@register(f"WITH {METRIC_ROWS} {_agg_sql('tag, metric', 'weight')}")
def agg_double_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agg.aggregate_metrics(t.metric_rows(spark, d), ["tag", "metric"], F.col("weight")))


def _reasons_sql(keys: str) -> str:
    """The aggregate with weighted fail counts and reasons, as text."""
    return f"""a AS ({_agg_sql(keys)}), rs AS (SELECT {keys}, string_agg(reason || ':' || n, ',' ORDER BY reason) AS r FROM (SELECT {keys}, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL)
        SELECT a.*, a.fail_count::DOUBLE AS weighted_fail_count, coalesce(rs.r, '') AS fail_reasons FROM a LEFT JOIN rs USING ({keys})"""


def _with_text(rows: DataFrame) -> DataFrame:
    return _rounded(rows).withColumn("fail_reasons", reasons_text(F.col("fail_reasons")))


@register(f"WITH {METRIC_ROWS}, {_reasons_sql('tag, params_key, metric')}")
def aggregate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _with_text(agg.aggregate_metrics(t.metric_rows(spark, d), reasons=True))


@register(f"WITH {METRIC_ROWS} {_agg_sql('tag, metric')}")
def multi_aggregator(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agg.aggregate_salted(t.metric_rows(spark, d), ["tag", "metric"]))


@register(f"WITH {METRIC_ROWS}, {_reasons_sql('tag, metric')}")
def merge_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return _with_text(agg.merge_aggregates(agg.aggregate_metrics(t.metric_rows(spark, d), reasons=True), ["tag", "metric"]))


@register(f"WITH {METRIC_ROWS} SELECT tag, metric, round(max(value), 6) AS highest, count(*) FILTER (value > 0.5)::BIGINT AS high, round(coalesce(avg(value), 0), 6) AS value, count(value) AS success_count, count(value)::DOUBLE AS weighted_success_count, count(*) - count(value) AS fail_count FROM m GROUP BY ALL")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of the caller's own beside the mean."""
    more = {"highest": F.round(F.max("value"), 6), "high": F.count_if(F.col("value") > 0.5)}
    return _rounded(agg.aggregate_metrics(t.metric_rows(spark, d), ["tag", "metric"], more=more))


_SPANS = """x AS (SELECT l_suppkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS low, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + floor(l_quantity / 4)::BIGINT AS high FROM lineitem),
    m AS (SELECT *, max(high) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x),
    i AS (SELECT *, sum(CASE WHEN seen IS NULL OR low > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM m),
    s AS (SELECT l_suppkey, island, min(low) AS low, max(high) AS high FROM i GROUP BY ALL), g AS (SELECT *, low - lag(high) OVER (PARTITION BY l_suppkey ORDER BY low) - 1 AS gap FROM s)"""


@register(f"WITH {_SPANS} SELECT l_suppkey, count(*) AS spans, sum(high - low + 1)::BIGINT AS days, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1")
def user_fold(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate by start, step and merge: the periods in which each supplier has something on its way, as a union of
    intervals, how many there are, their days and the longest gap between two."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = t.table(spark, d, "lineitem").select("l_suppkey", day.alias("low"), (day + F.floor(F.col("l_quantity") / 4)).alias("high"))
    return fold.user_aggregate(rows, ["l_suppkey"], ["low", "high"], fold.Spans.start, fold.Spans.step, fold.Spans.merge, "spans long, days long, longest_gap long", fold.Spans.finish)


@register(f"WITH {METRIC_ROWS} SELECT 'segment ' || lower(tag) AS tag, metric, round(coalesce(avg(value), 0), 6) AS value, count(value) AS success_count, count(value)::DOUBLE AS weighted_success_count, count(*) - count(value) AS fail_count FROM m WHERE tag LIKE '%A%' GROUP BY ALL")
def user_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A filter and a mapping of tags by the caller's own functions of columns."""
    rows = tags.tag_filter_map(t.metric_rows(spark, d), F.col("tag").contains("A"), F.concat(F.lit("segment "), F.lower("tag")))
    return _rounded(agg.aggregate_metrics(rows, ["tag", "metric"]))


@register(f"WITH {METRIC_ROWS} SELECT tag, metric, reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY ALL")
def agg_fail_reasons(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_fail_reasons(t.metric_rows(spark, d), ["tag", "metric"])


@register(f"WITH {METRIC_ROWS}, r AS (SELECT tag, params_key, query, bool_or(reason IS NULL) AS ok FROM m GROUP BY ALL) SELECT tag, params_key, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY ALL")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return agg.row_counts(t.metric_rows(spark, d), ["tag", "params_key"], ["query"])


@register(f"WITH {METRIC_ROWS} SELECT tag, round(avg(value), 6) AS value, count(value) AS n FROM m GROUP BY tag")
def agg_running_avg(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_running_avg(t.metric_rows(spark, d), "value", ["tag"]).withColumn("value", F.round("value", 6))


@register(f"WITH {REQUESTS} SELECT tag, nation, count(*) AS n FROM requests GROUP BY ALL")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_count(t.requests(spark, d), ["tag", "nation"])


_WEIGHTS = "w AS (SELECT n_name AS key, 1.0 + n_nationkey AS weight FROM nation WHERE n_nationkey % 3 <> 0)"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("key"), (F.lit(1.0) + F.col("n_nationkey")).alias("weight"))


@register(f"WITH {METRIC_ROWS}, {_WEIGHTS}, x AS (SELECT m.* EXCLUDE (weight), coalesce(w.weight, 0.5) AS weight FROM m LEFT JOIN w ON m.nation = w.key) {_agg_sql('tag, metric', 'weight', 'x')}")
def weight_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = agg.weight_lookup(t.metric_rows(spark, d).drop("weight"), _weights(spark, d), F.col("nation"), 0.5)
    return _rounded(agg.aggregate_metrics(rows, ["tag", "metric"], F.col("weight")))


@register(f"WITH {METRIC_ROWS} {_agg_sql('tag, metric', '4.0')}")
def weight_constant(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agg.aggregate_metrics(t.metric_rows(spark, d), ["tag", "metric"], F.lit(4.0)))


@register(f"WITH {METRIC_ROWS}, x AS (SELECT * REPLACE (2.5 AS weight) FROM m) {_agg_sql('tag, metric', 'weight', 'x')}")
def apply_weight(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agg.apply_weight(agg.aggregate_metrics(t.metric_rows(spark, d), ["tag", "metric"]), F.lit(2.5)))


@register(f"WITH {METRIC_ROWS}, {_WEIGHTS}, x AS (SELECT '(ALL)' AS tag, params_key, metric, value, coalesce(w.weight, 1.0) AS weight FROM m LEFT JOIN w ON m.nation = w.key WHERE regexp_matches(m.nation, '[AEI]')) {_agg_sql('tag, params_key, metric', 'weight', 'x')}")
def aggregate_all_weighted(spark: SparkSession, d: str) -> DataFrame:
    by_nation = agg.aggregate_metrics(t.metric_rows(spark, d).withColumn("tag", text.single_tag("nation", F.col("nation"))))
    key = agg.stripped(F.col("tag"), "(nation=", ")")
    return _rounded(agg.aggregate_all_weighted(by_nation, key.rlike("[AEI]"), _weights(spark, d), key))


_GROUPS = "g AS (SELECT r_name AS grp, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'EVERYWHERE', n_name FROM nation)"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    nation, region = t.table(spark, d, "nation"), t.table(spark, d, "region")
    groups = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("group"), F.col("n_name").alias("member"))
    return groups.unionByName(nation.select(F.lit("EVERYWHERE").alias("group"), F.col("n_name").alias("member")))


@register(f"""WITH {METRIC_ROWS}, {_GROUPS}, x AS (SELECT g.grp AS "group", m.* FROM m JOIN g ON m.nation = g.member) {_agg_sql('"group", params_key, metric', source='x')}""")
def aggregate_groups(spark: SparkSession, d: str) -> DataFrame:
    by_nation = agg.aggregate_metrics(t.metric_rows(spark, d).withColumn("tag", F.col("nation")))
    return _rounded(agg.aggregate_groups(by_nation, _groups(spark, d), F.col("tag")))


@register(f"""WITH {METRIC_ROWS}, {_GROUPS}, p AS (SELECT DISTINCT grp, member[1:2] AS start FROM g), x AS (SELECT DISTINCT p.grp AS "group", m.* FROM m JOIN p ON starts_with(m.nation, p.start)) {_agg_sql('"group", params_key, metric', source='x')}""")
def aggregate_groups_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    by_nation = agg.aggregate_metrics(t.metric_rows(spark, d).withColumn("tag", F.col("nation")))
    starts = _groups(spark, d).withColumn("member", F.left("member", F.lit(2)))
    return _rounded(agg.aggregate_groups(by_nation, starts, F.col("tag"), prefix=True))


@register(f"""WITH {METRIC_ROWS}, {_GROUPS}, p AS (SELECT DISTINCT grp, member[1] || '[A-Z ]*' || member[-2:] || '|' || member[2] || '.?' || member[1:2] || '+' AS pattern FROM g), x AS (SELECT DISTINCT p.grp AS "group", m.* FROM m JOIN p ON regexp_matches(m.nation, '^(?:' || p.pattern || ')')) {_agg_sql('"group", params_key, metric', source='x')}""")
def aggregate_groups_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose members are patterns that tags begin with."""
    by_nation = agg.aggregate_metrics(t.metric_rows(spark, d).withColumn("tag", F.col("nation")))
    m = F.col("member")
    pattern = F.concat(F.left(m, F.lit(1)), F.lit("[A-Z ]*"), F.right(m, F.lit(2)), F.lit("|"), F.substr(m, F.lit(2), F.lit(1)), F.lit(".?"), F.left(m, F.lit(2)), F.lit("+"))
    return _rounded(agg.aggregate_groups(by_nation, _groups(spark, d).withColumn("member", pattern), F.col("tag"), pattern=True))


@register(f"WITH {METRIC_ROWS} {_agg_sql('tag, metric')}")
def merge_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = agg.aggregate_metrics(t.metric_rows(spark, d), ["tag", "metric", "nation"])
    left, right = rows.filter("nation < 'J'"), rows.filter("nation >= 'J'")
    return _rounded(agg.merge_metric_rows(left.drop("nation"), right.drop("nation"), ["tag", "metric"]))


def _quantity_maps(spark: SparkSession, d: str) -> DataFrame:
    """``query, mode, weight, quantities MAP<status, quantity>`` an order."""
    by = t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    maps = by.groupBy(F.col("l_orderkey").alias("query")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "q"))).alias("quantities"))
    return maps.withColumns({"mode": F.col("query") % 5, "weight": (1 + F.col("query") % 3).cast("double")})


_MAPS = 'q AS (SELECT l_orderkey AS query, l_orderkey % 5 AS mode, 1.0 + l_orderkey % 3 AS weight, l_linestatus AS "key", sum(l_quantity) AS v FROM lineitem GROUP BY ALL)'


@register(f'WITH {_MAPS} SELECT mode, "key", round(sum(v), 6) AS value FROM q GROUP BY ALL')
def agg_map_sum(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_map_sum(_quantity_maps(spark, d), ["mode"], "quantities").withColumn("value", F.round("value", 6))


@register(f'WITH {_MAPS} SELECT mode, "key", round(sum(weight * v), 6) AS value FROM q GROUP BY ALL')
def agg_map_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_map_sum(_quantity_maps(spark, d), ["mode"], "quantities", F.col("weight")).withColumn("value", F.round("value", 6))


@register(f'WITH {_MAPS} SELECT mode, "key", round(sum(weight * v) / sum(weight), 6) AS value FROM q GROUP BY ALL')
def agg_map_avg(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_map_avg(_quantity_maps(spark, d), ["mode"], "quantities", F.col("weight")).withColumn("value", F.round("value", 6))


@register(f'WITH {_MAPS} SELECT mode, "key", round(sum(v) / 4, 6) AS value FROM q GROUP BY ALL')
def scale_map(spark: SparkSession, d: str) -> DataFrame:
    scaled = _quantity_maps(spark, d).withColumn("quantities", text.scale_map(F.col("quantities"), F.lit(0.25)))
    return agg.agg_map_sum(scaled, ["mode"], "quantities").withColumn("value", F.round("value", 6))


@register("SELECT l_orderkey % 7 AS mode, l_linestatus AS \"key\", CASE WHEN count(DISTINCT l_orderkey % 2) = 2 THEN round((max(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END) + max(CASE WHEN l_orderkey % 2 = 1 THEN l_quantity END)) / 2, 6) ELSE max(l_quantity) END AS value FROM lineitem GROUP BY ALL")
def combine_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("mode"), (F.col("l_orderkey") % 2).alias("half"), "l_linestatus").agg(F.max("l_quantity").alias("q"))
    maps = rows.groupBy("mode", "half").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "q"))).alias("m"))
    both = maps.filter("half = 0").select("mode", F.col("m").alias("a")).join(maps.filter("half = 1").select("mode", F.col("m").alias("b")), "mode")
    return both.select("mode", F.explode(text.combine_maps(F.col("a"), F.col("b"), lambda x, y: F.round((x + y) / 2, 6))).alias("key", "value"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    types = t.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    return types.select((F.col("user_id") % 3).alias("mode"), (1 + F.col("user_id") % 4).cast("double").alias("weight"), ranking.position_histogram(F.col("types"), 4).alias("h"))


_NESTED = """u AS (SELECT user_id, list(event_type ORDER BY ts, event_id)[1:4] AS types FROM events GROUP BY 1),
    x AS (SELECT user_id % 3 AS mode, 1.0 + user_id % 4 AS weight, unnest(types) AS "key", unnest(range(0, len(types)))::VARCHAR AS position FROM u)"""


@register(f'WITH {_NESTED} SELECT mode, "key", position, count(*)::DOUBLE AS value FROM x GROUP BY ALL')
def agg_nested_map_sum(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_nested_map_sum(_nested(spark, d), ["mode"], "h")


@register(f'WITH {_NESTED} SELECT mode, "key", position, sum(weight)::DOUBLE AS value FROM x GROUP BY ALL')
def agg_nested_map_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_nested_map_sum(_nested(spark, d), ["mode"], "h", F.col("weight"))


@register("SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events WHERE value > 10 GROUP BY 1")
def agg_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 10, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("types"))
    return agg.agg_keep_first(rows, ["user_id"], "types", "event_id").select("user_id", F.col("types")[0].alias("first_type"))


@register(f"WITH {REQUESTS} SELECT '(priority=' || prio || ')' AS tag, count(*) AS n FROM requests GROUP BY 1")
def tag_by_param(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_count(t.requests(spark, d).withColumn("tag", tags.tag_by_param(F.col("params"), "priority")), ["tag"])


@register("WITH x AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT '(products-size=' || k || ')' AS tag, count(*) AS n FROM x GROUP BY 1")
def tag_by_length(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("products"))
    return agg.agg_count(rows.withColumn("tag", tags.tag_by_length(F.col("products"), "products")), ["tag"])


@register(f"""WITH {REQUESTS}, x AS (SELECT unnest(['(nation=' || nation || ')-(segment=' || tag || ')', '(status=' || stat || ')']) AS tag FROM requests) SELECT tag, count(*) AS n FROM x GROUP BY 1""")
def tag_extend(spark: SparkSession, d: str) -> DataFrame:
    rows = t.requests(spark, d).withColumn("tags", F.array(text.single_tag("segment", F.col("tag")))).drop("tag")
    rows = rows.withColumn("tags", tags.tag_extend(F.col("tags"), text.single_tag("nation", F.col("nation")), True))
    rows = rows.withColumn("tags", tags.tag_extend(F.col("tags"), tags.tag_by_param(F.col("params"), "status"), False))
    return agg.agg_count(tags.explode_tags(rows), ["tag"])


@register(f"WITH {METRIC_ROWS}, x AS (SELECT '(ALL)' AS tag, metric, value FROM m) {_agg_sql('tag, metric', source='x')}")
def tag_remap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agg.aggregate_metrics(tags.tag_remap(t.metric_rows(spark, d), F.lit("(ALL)")), ["tag", "metric"]))


@register(f"WITH {REQUESTS} SELECT 'seg-' || lower(tag) AS tag, count(*) AS n FROM requests WHERE tag LIKE '%U%' GROUP BY 1")
def tag_filter_map(spark: SparkSession, d: str) -> DataFrame:
    rows = tags.tag_filter_map(t.requests(spark, d), F.col("tag").like("%U%"), F.concat(F.lit("seg-"), F.lower("tag")))
    return agg.agg_count(rows, ["tag"])


@register(f"WITH {REQUESTS} SELECT 'status=' || stat AS params_key, count(*) AS n FROM requests GROUP BY 1")
def exclude_params(spark: SparkSession, d: str) -> DataFrame:
    rows = t.requests(spark, d).withColumn("params_key", text.params_key(tags.exclude_params(F.col("params"), ["priority"])))
    return agg.agg_count(rows, ["params_key"])


@register(f"""WITH {REQUESTS} SELECT '{{"tag":"' || tag || '","nation":"' || nation || '"}}' AS context_info, count(*) AS n FROM requests GROUP BY 1""")
def carry_context(spark: SparkSession, d: str) -> DataFrame:
    return agg.agg_count(t.requests(spark, d).withColumn("context_info", tags.carry_context("tag", "nation")), ["context_info"])


@register(f"WITH {REQUESTS} SELECT 'aggTag-' || tag || '-priority=' || prio || '-status=' || stat AS tag, count(*) AS n FROM requests GROUP BY 1")
def tag_string(spark: SparkSession, d: str) -> DataFrame:
    only = lambda k: F.map_filter("params", lambda name, _: name == k)
    return agg.agg_count(t.requests(spark, d).withColumn("tag", text.aggregation_tag(F.col("tag"), only("priority"), only("status"))), ["tag"])
