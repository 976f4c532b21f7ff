"""The driver's tables in the roles of results, judgements, requests and metric rows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevanta.functions import ranking
from relevanta.functions.text import params_key
from relevanta.operators.judgements import judged_lists
from relevanta.operators.metrics import calculate_metrics
from relevanta.operators.metrics import metric_records as records_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, product, rank``: an order is a query, its lines the result list."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("product"), F.row_number().over(order).alias("rank"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, product, grade``: quantity over 50 of the lines that were returned or kept; the others aren't judged."""
    judged = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    return judged.groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("product")).agg((F.max("l_quantity") / 50.0).alias("grade"))


def lists(spark: SparkSession, sf_dir: str, constant: float | None = 0.0, most_missing: float | None = None) -> DataFrame:
    return judged_lists(results(spark, sf_dir), judgements(spark, sf_dir), ["query"], constant, most_missing)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, tag, params, params_key, nation``: an order's segment is its tag, priority and status its parameters."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # an order or customer key may repeat in the data: one row a key
    orders = orders.groupBy("o_orderkey").agg(F.min(F.struct("o_custkey", "o_orderpriority", "o_orderstatus")).alias("o"))
    customers = customers.groupBy("c_custkey").agg(F.min(F.struct("c_mktsegment", "c_nationkey")).alias("c"))
    rows = orders.join(customers, F.col("o.o_custkey") == F.col("c_custkey")).join(nations, F.col("c.c_nationkey") == F.col("n_nationkey"))
    params = F.create_map(F.lit("priority"), F.array("o.o_orderpriority"), F.lit("status"), F.array("o.o_orderstatus"))
    return rows.select(F.col("o_orderkey").alias("query"), F.col("c.c_mktsegment").alias("tag"), params.alias("params"), params_key(params).alias("params_key"), F.col("n_name").alias("nation"))


_ASKED = ["query", "tag", "params", "params_key", "nation"]


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Lists with their requests, and NDCG@4, PRECISION@2 and RECALL@2 of them."""
    current, best = F.col("current"), F.col("ideal")
    metrics = {"NDCG@4": ranking.ndcg_at_k(current, best, 4), "PRECISION@2": ranking.precision_at_k(current, 2, 0.5), "RECALL@2": ranking.recall_at_k(current, best, 2, 0.5)}
    # lists meet their requests before each becomes a row a metric
    return lists(spark, sf_dir).join(requests(spark, sf_dir), "query"), metrics


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, tag, params, params_key, nation, weight, metric, value, reasons``."""
    return calculate_metrics(*_asked(spark, sf_dir), _ASKED).withColumn("weight", (1 + F.col("query") % 3).cast("double"))


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, tag, params, params_key, nation, records``: a request with all its metrics."""
    return records_of(*_asked(spark, sf_dir), _ASKED)


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated rows ``tag, params, params_key, metric, value, success_count, weighted_success_count, fail_count``."""
    from relevanta.operators.aggregate import KEYS, aggregate_metrics

    rows = aggregate_metrics(metric_rows(spark, sf_dir))
    split = F.str_to_map("params_key", F.lit("&"), F.lit("="))
    return rows.select(*KEYS, F.transform_values(split, lambda _, v: F.array(v)).alias("params"), F.round("value", 6).alias("value"), "success_count", "weighted_success_count", "fail_count")


RESULTS = "results AS (SELECT l_orderkey AS query, l_partkey AS product, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rank FROM lineitem)"
JUDGEMENTS = "judgements AS (SELECT l_orderkey AS query, l_partkey AS product, max(l_quantity) / 50.0 AS grade FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)"
GRADED = f"{RESULTS}, {JUDGEMENTS}, graded AS (SELECT r.query, r.product, r.rank, j.grade FROM results r LEFT JOIN judgements j ON r.query = j.query AND r.product = j.product)"
KNOWN = "known AS (SELECT query, list(grade ORDER BY grade DESC) AS known FROM judgements GROUP BY query)"
LISTS = f"""{GRADED}, {KNOWN}, plain AS (SELECT query, list(grade ORDER BY rank) AS grades, list(coalesce(grade, 0.0) ORDER BY rank) AS current, count(*) AS n, count(grade) AS judged FROM graded GROUP BY query),
    lists AS (SELECT p.*, list_reverse_sort(list_concat(coalesce(k.known, [])[1:p.n], list_transform(range(0, p.n - p.judged), lambda x: 0.0::DOUBLE)))[1:p.n] AS ideal FROM plain p LEFT JOIN known k ON p.query = k.query)"""


def dcg_sql(values: str, k: int) -> str:
    return f"coalesce(list_sum(list_transform(({values})[1:{k}], lambda x, i: CASE WHEN i = 1 THEN x ELSE x / ln(i + 1) END)), 0.0)"


def over_sql(values: str, k: int, threshold: float) -> str:
    return f"len(list_filter(({values})[1:{k}], lambda x: x >= {threshold}))"


REQUESTS = """requests AS (
    SELECT o.o_orderkey AS query, c.seg AS tag, 'priority=' || o.prio || '&status=' || o.stat AS params_key, o.prio, o.stat, n_name AS nation FROM
    (SELECT o_orderkey, x.c AS o_custkey, x.p AS prio, x.s AS stat FROM (SELECT o_orderkey, min({'c': o_custkey, 'p': o_orderpriority, 's': o_orderstatus}) AS x FROM orders GROUP BY 1)) o
    JOIN (SELECT c_custkey, x.s AS seg, x.n AS nk FROM (SELECT c_custkey, min({'s': c_mktsegment, 'n': c_nationkey}) AS x FROM customer GROUP BY 1)) c ON o.o_custkey = c.c_custkey
    JOIN nation ON c.nk = n_nationkey)"""
METRIC_ROWS = f"""{LISTS}, {REQUESTS}, each_metric AS (
    SELECT query, 'NDCG@4' AS metric, CASE WHEN judged = 0 THEN NULL WHEN n = 1 THEN CASE WHEN current[1] > 0 THEN 1.0 END WHEN {dcg_sql("ideal", 4)} = 0 THEN NULL ELSE {dcg_sql("current", 4)} / {dcg_sql("ideal", 4)} END AS value, judged FROM lists
    UNION ALL SELECT query, 'PRECISION@2', CASE WHEN judged > 0 THEN {over_sql("current", 2, 0.5)} / least(n, 2) END, judged FROM lists
    UNION ALL SELECT query, 'RECALL@2', CASE WHEN judged > 0 AND {over_sql("ideal", 2, 0.5)} > 0 THEN {over_sql("current", 2, 0.5)} / {over_sql("ideal", 2, 0.5)} END, judged FROM lists),
    m AS (SELECT e.query, r.tag, r.params_key, r.prio, r.stat, r.nation, e.metric, e.value, CASE WHEN e.value IS NULL THEN CASE WHEN e.judged = 0 THEN 'NO_JUDGEMENTS' ELSE 'ZERO_DENOMINATOR' END END AS reason, 1.0 + e.query % 3 AS weight
        FROM each_metric e JOIN requests r ON e.query = r.query)"""
SETTINGS = f"""{METRIC_ROWS}, settings AS (SELECT tag, params_key, prio, stat, metric, round(coalesce(avg(value), 0.0), 6) AS value, count(value) AS success_count, count(*) - count(value) AS fail_count FROM m GROUP BY ALL)"""
