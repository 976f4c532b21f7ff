"""Queries over result lists: judgements, ranking metrics, value lists, two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevanta.functions import ranking
from relevanta.operators import metrics
from relevanta.operators.aggregate import aggregate_metrics
from relevanta.operators.judgements import ideal_grades
from relevanta.operators.judgements import join_judgements as join
from relevanta.plans import tables as t
from relevanta.plans.tables import GRADED, JUDGEMENTS, KNOWN, LISTS, METRIC_ROWS, dcg_sql, over_sql

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _metric(rows: DataFrame, keys: list[str], m: Column) -> DataFrame:
    return rows.select(*keys, m.alias("m")).select(*keys, F.round("m.value", 6).alias("value"), F.array_join("m.reasons", ",").alias("reasons"))


@register(f"WITH {GRADED} SELECT query, product, rank::INT AS rank, grade FROM graded")
def join_judgements(spark: SparkSession, d: str) -> DataFrame:
    return join(t.results(spark, d), t.judgements(spark, d)).select("query", "product", "rank", "grade")


@register(f"WITH {LISTS} SELECT query, unnest(range(1, len(ideal) + 1))::INT AS pos, unnest(ideal) AS grade FROM lists WHERE n > 0")
def ideal_ranking(spark: SparkSession, d: str) -> DataFrame:
    return t.lists(spark, d).select("query", F.posexplode("ideal").alias("pos", "grade")).withColumn("pos", F.col("pos") + 1)


@register(f"WITH {JUDGEMENTS}, {KNOWN} SELECT query, len(known)::INT AS n, known[1] AS best, known[len(known)] AS worst FROM known")
def judgements_of_query(spark: SparkSession, d: str) -> DataFrame:
    return ideal_grades(t.judgements(spark, d)).select("query", F.size("known").alias("n"), F.col("known")[0].alias("best"), F.element_at("known", -1).alias("worst"))


@register(f"WITH {GRADED} SELECT query, rank::INT AS rank, round(coalesce(grade, avg(grade) OVER (PARTITION BY query), 0.0), 6) AS grade FROM graded")
def impute_missing(spark: SparkSession, d: str) -> DataFrame:
    return t.lists(spark, d, constant=None).select("query", F.posexplode("current").alias("rank", "grade")).select("query", (F.col("rank") + 1).alias("rank"), F.round("grade", 6).alias("grade"))


@register(f"WITH {LISTS} SELECT query, concat_ws(',', CASE WHEN judged = 0 THEN 'NO_JUDGEMENTS' END, CASE WHEN n - judged > n * 0.1::DOUBLE THEN 'TOO_FEW_JUDGEMENTS' END) AS reasons FROM lists")
def validate_judgements(spark: SparkSession, d: str) -> DataFrame:
    return t.lists(spark, d, most_missing=0.1).select("query", F.array_join("failed", ",").alias("reasons"))


@register(
    f"""WITH {LISTS} SELECT query, metric, value::DOUBLE AS value FROM (
    {" UNION ALL ".join(f"SELECT query, 'J@{k}' AS metric, len(list_filter(grades[1:{k}], lambda x: x IS NOT NULL)) AS value FROM lists" for k in (2, 4, 8, 12, 24))}
    UNION ALL SELECT query, 'MISSING@8', len(list_filter(grades[1:8], lambda x: x IS NULL)) FROM lists UNION ALL SELECT query, 'MISSING', n - judged FROM lists UNION ALL SELECT query, 'RESULTS', n FROM lists)"""
)
def judgement_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calculate_metrics(t.lists(spark, d), metrics.coverage_metrics(), ["query"], failed_col=None).drop("reasons")


@register(f"WITH {LISTS} SELECT query, round(CASE WHEN n = 1 THEN current[1] ELSE {dcg_sql('current', 4)} END, 6) AS value, '' AS reasons FROM lists")
def dcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metric(t.lists(spark, d), ["query"], ranking.dcg_at_k(F.col("current"), 4))


@register(f"WITH {METRIC_ROWS} SELECT tag, round(avg(value), 6) AS value, count(value) AS success_count, count(*) - count(value) AS fail_count FROM m WHERE metric = 'NDCG@4' GROUP BY tag")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.calculate_metrics(t.lists(spark, d), {"NDCG@4": ranking.ndcg_at_k(F.col("current"), F.col("ideal"), 4)}, ["query"])
    tagged = rows.join(t.requests(spark, d).select("query", "tag"), "query")
    return aggregate_metrics(tagged, ["tag"]).select("tag", F.round("value", 6).alias("value"), "success_count", "fail_count")


@register(f"WITH {LISTS} SELECT query, round({over_sql('current', 4, 0.5)} / least(n, 4), 6) AS value, '' AS reasons FROM lists")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metric(t.lists(spark, d), ["query"], ranking.precision_at_k(F.col("current"), 4, 0.5))


@register(f"WITH {LISTS}, x AS (SELECT query, {over_sql('current', 4, 0.5)} AS a, {over_sql('ideal', 4, 0.5)} AS b FROM lists) SELECT query, CASE WHEN b > 0 THEN round(a / b, 6) END AS value, CASE WHEN b = 0 THEN 'ZERO_DENOMINATOR' ELSE '' END AS reasons FROM x")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metric(t.lists(spark, d), ["query"], ranking.recall_at_k(F.col("current"), F.col("ideal"), 4, 0.5))


@register(
    f"""WITH {GRADED}, r AS (SELECT query, rank, (pow(2, coalesce(grade, 0.0) * 3) - 1) / 8 AS r FROM graded WHERE rank <= 5),
    x AS (SELECT query, r / rank * coalesce(exp(sum(ln(1 - r)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS v FROM r)
    SELECT query, round(sum(v), 6) AS value, '' AS reasons FROM x GROUP BY query"""
)
def err_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metric(t.lists(spark, d), ["query"], ranking.err_at_k(F.col("current"), 5))


@register("SELECT o_orderkey AS query, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def metric_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), ranking.identity(F.col("o_totalprice")).alias("m"))
    return rows.groupBy("query").agg(F.count("*").alias("n"), F.round(F.sum("m.value"), 2).alias("value"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    ranked = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", (F.col("l_linestatus") == "F").alias("flag"))
    return t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["flag"]).alias("flags"))


_FLAGS = "f AS (SELECT l_orderkey AS query, list(l_linestatus = 'F' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_linestatus = 'F') AS flags FROM lineitem GROUP BY 1)"


def _flag_query(name: str, metric, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _metric(_flags(spark, d), ["query"], metric(F.col("flags")))

    QUERIES[name], ORACLES[name] = query, f"WITH {_FLAGS} {sql}"


for _name, _wanted in (("true", True), ("false", False)):
    _flag_query(f"first_{_name}", lambda x, w=_wanted: ranking.first_match(x, w), f"SELECT query, CASE WHEN list_contains(flags, {_wanted}) THEN (list_position(flags, {_wanted}) - 1)::DOUBLE END AS value, CASE WHEN list_contains(flags, {_wanted}) THEN '' ELSE 'NO_RESULTS' END AS reasons FROM f")
    _flag_query(f"{_name}_count", lambda x, w=_wanted: ranking.match_count(x, w), f"SELECT query, len(list_filter(flags, lambda x: x = {_wanted}))::DOUBLE AS value, '' AS reasons FROM f")
    _flag_query(f"binary_precision_{_name}", lambda x, w=_wanted: ranking.binary_precision(x, 3, w), f"SELECT query, round(len(list_filter(flags[1:3], lambda x: x = {_wanted})) / len(flags[1:3]), 6) AS value, '' AS reasons FROM f")


def _types(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))


_TYPES = "u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY 1)"


@register(f"WITH {_TYPES}, x AS (SELECT user_id, unnest(types[1:5]) AS value, unnest(range(0, len(types[1:5]))) AS position FROM u) SELECT value, position::VARCHAR AS position, count(*)::DOUBLE AS n FROM x GROUP BY ALL")
def position_histogram(spark: SparkSession, d: str) -> DataFrame:
    from relevanta.operators.aggregate import agg_nested_map_sum

    rows = _types(spark, d).select(ranking.position_histogram(F.col("types"), 5).alias("h"), F.lit(1).alias("_all"))
    return agg_nested_map_sum(rows, ["_all"], "h").select(F.col("key").alias("value"), "position", F.col("value").alias("n"))


@register(f"WITH {_TYPES}, x AS (SELECT user_id, types, unnest(list_distinct(types[1:4])) AS value FROM u) SELECT user_id, value, len(list_filter(types, lambda y: y = value))::DOUBLE AS n FROM x")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).select("user_id", F.explode(ranking.value_counts(F.col("types"), 4)).alias("value", "n"))


@register(f"WITH {_TYPES} SELECT user_id, unnest(list_distinct(types[1:4])) AS value FROM u")
def unique_values(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).select("user_id", F.explode(ranking.unique_values(F.col("types"), 4)).alias("value"))


@register(f"WITH {_TYPES} SELECT user_id, len(list_distinct(types[1:4]))::DOUBLE AS value, '' AS reasons FROM u")
def unique_value_count(spark: SparkSession, d: str) -> DataFrame:
    return _metric(_types(spark, d), ["user_id"], ranking.unique_value_count(F.col("types"), 4))


@register(f"WITH {_TYPES} SELECT user_id, len(list_filter(types[1:6], lambda y: y = 'click'))::DOUBLE AS value, '' AS reasons FROM u")
def occurrences_of(spark: SparkSession, d: str) -> DataFrame:
    return _metric(_types(spark, d), ["user_id"], ranking.occurrences_of(F.col("types"), "click", 6, within_k=True))


def _by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("product"), (F.year("l_shipdate") % 2).cast("string").alias("source"))
    order = Window.partitionBy("query", "source").orderBy("product")
    return rows.withColumn("rank", F.row_number().over(order))


_YEARS = "y AS (SELECT l_suppkey AS query, list(DISTINCT l_partkey) FILTER (year(l_shipdate) % 2 = 0) AS a, list(DISTINCT l_partkey) FILTER (year(l_shipdate) % 2 = 1) AS b FROM lineitem GROUP BY 1)"


@register(f"WITH {_YEARS} SELECT query, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS value, concat_ws(',', CASE WHEN coalesce(len(a), 0) = 0 THEN 'MISSING_DATA_KEY-0' END, CASE WHEN coalesce(len(b), 0) = 0 THEN 'MISSING_DATA_KEY-1' END) AS reasons FROM y")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.compare_sources(_by_year(spark, d), ["query"], "source", "0", "1")
    return _metric(pairs, ["query"], ranking.jaccard(F.col("left"), F.col("right"), ("0", "1")))


@register("SELECT l_suppkey AS query, count(*) FILTER (year(l_shipdate) % 2 = 0) AS n_left, count(*) FILTER (year(l_shipdate) % 2 = 1) AS n_right FROM lineitem GROUP BY 1")
def compare_sources(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.compare_sources(_by_year(spark, d), ["query"], "source", "0", "1")
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return pairs.select("query", n("left").alias("n_left"), n("right").alias("n_right"))


@register("WITH r AS (SELECT DISTINCT l_suppkey AS query, (year(l_shipdate) % 2)::VARCHAR AS source, l_partkey FROM lineitem), p AS (SELECT query, arg_min(source, md5(query || '|' || source)) AS source FROM r GROUP BY 1) SELECT query, source, count(*) AS n FROM r JOIN p USING (query, source) GROUP BY ALL")
def one_source_each(spark: SparkSession, d: str) -> DataFrame:
    """Each request's results from one of its two sources."""
    rows = metrics.one_source_each(_by_year(spark, d), ["query"], "source")
    return rows.groupBy("query", "source").agg(F.countDistinct("product").alias("n"))


@register(f"WITH {LISTS} SELECT query, CASE WHEN judged > 0 THEN round(coalesce(1.0 / nullif(list_position(list_transform(current, lambda x: x >= 0.5), true), 0), 0.0), 6) END AS rr, CASE WHEN judged > 0 THEN round(ideal[1] - current[1], 6) END AS gap FROM lists")
def user_metric(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the caller's own: functions of one column and of two, beside the built-in ones."""
    first = F.array_position(F.transform("current", lambda x: x >= 0.5), F.lit(True))
    own = {"rr": ranking.ok(F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0))), "gap": ranking.ok(F.get("ideal", F.lit(0)) - F.get("current", F.lit(0)))}
    rows = metrics.calculate_metrics(t.lists(spark, d), own, ["query"])
    return rows.groupBy("query").pivot("metric", ["rr", "gap"]).agg(F.round(F.first("value"), 6))


_PRESET = " UNION ALL ".join(
    [f"SELECT query, 'NDCG@{k}' AS metric, CASE WHEN judged = 0 THEN NULL WHEN n = 1 THEN CASE WHEN current[1] > 0 THEN 1.0 END WHEN {dcg_sql('ideal', k)} = 0 THEN NULL ELSE {dcg_sql('current', k)} / {dcg_sql('ideal', k)} END AS value FROM lists" for k in metrics.NDCG_AT]
    + [f"SELECT query, 'PRECISION@k={k},t=0.2', CASE WHEN judged > 0 THEN {over_sql('current', k, 0.2)} / least(n, {k}) END FROM lists" for k in (2, 4)]
    + [f"SELECT query, 'RECALL@k={k},t=0.2', CASE WHEN judged > 0 AND {over_sql('ideal', k, 0.2)} > 0 THEN {over_sql('current', k, 0.2)} / {over_sql('ideal', k, 0.2)} END FROM lists" for k in (2, 4)]
)


@register(f"WITH {LISTS}, e AS ({_PRESET}) SELECT query, metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END::BIGINT AS n_reasons FROM e")
def calculate_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.calculate_metrics(t.lists(spark, d), metrics.ranking_metrics(), ["query"])
    return rows.select("query", "metric", F.round("value", 6).alias("value"), F.size("reasons").cast("long").alias("n_reasons"))


@register(f"""WITH {LISTS}, x AS (SELECT query, current[1] AS a, current[2] AS b, judged FROM lists)
    SELECT query, 'ratio' AS metric, CASE WHEN judged > 0 AND b IS NOT NULL AND b <> 0 THEN round(a / b, 6) END AS value, CASE WHEN judged = 0 THEN 'NO_JUDGEMENTS' WHEN b IS NULL THEN 'MISSING_DATA_KEY-second' WHEN b = 0 THEN 'ZeroDivisionError' ELSE '' END AS reasons FROM x
    UNION ALL SELECT query, 'clicks', NULL, CASE WHEN judged = 0 THEN 'NO_JUDGEMENTS' ELSE 'MISSING_DATA_KEY-clicks' END FROM x
    UNION ALL SELECT query, 'first', CASE WHEN judged > 0 THEN round(a, 6) END, CASE WHEN judged = 0 THEN 'NO_JUDGEMENTS' ELSE '' END FROM x""")
def failing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A metric fails alone: for data that a row or the whole table lacks, or with the error that its own code raises."""
    rows = t.lists(spark, d).withColumns({"first": F.get("current", F.lit(0)), "second": F.get("current", F.lit(1))})
    own = {"ratio": ranking.python_metric(lambda a, b: a / b, F.col("first"), F.coalesce("second", F.lit(1.0))), "clicks": ranking.ok(F.lit(1.0)), "first": ranking.ok(F.col("first"))}
    found = metrics.calculate_metrics(rows, own, ["query"], needs={"ratio": ["first", "second"], "clicks": ["clicks"], "first": ["first"]})
    return found.select("query", "metric", F.round("value", 6).alias("value"), F.array_join("reasons", ",").alias("reasons"))


_JUDGED = " UNION ALL ".join(f"SELECT query, 'J@{k}' AS metric, len(list_filter(grades[1:{k}], lambda x: x IS NOT NULL))::DOUBLE AS value FROM lists" for k in metrics.JUDGED_AT)


@register(f"WITH {LISTS}, e AS ({_JUDGED} UNION ALL {_PRESET}) SELECT '(ALL)' AS tag, metric, round(coalesce(avg(value), 0), 6) AS value, count(value) AS success_count, count(*) - count(value) AS fail_count FROM e GROUP BY metric")
def default_query_metrics(spark: SparkSession, d: str) -> DataFrame:
    from relevanta.operators.aggregate import merge_aggregates, to_metric_value

    # a query has one list, so its own aggregate under "(q=...)" is its row: no table of all queries' groups is kept
    rows = metrics.calculate_metrics(t.lists(spark, d), metrics.list_metrics(), ["query"], always=metrics.judged_metrics())
    by_query = to_metric_value(rows.withColumn("tag", F.concat(F.lit("(q="), F.col("query").cast("string"), F.lit(")"))))
    by_query = by_query.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return merge_aggregates(by_query.withColumn("tag", F.lit("(ALL)")), ["tag", "metric"]).select("tag", "metric", F.round("value", 6).alias("value"), "success_count", "fail_count")
