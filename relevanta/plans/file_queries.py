"""Sources and sinks: table rows are written in each format to the shared folder and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions import text
from relevanta.operators.aggregate import aggregate_typed
from relevanta.operators.judgements import last_grades
from relevanta.operators.summary import run_summary
from relevanta.operators.tags import carry_context
from relevanta.plans import tables as t
from relevanta.plans.summary_queries import SUMMARY, summary_columns
from relevanta.plans.tables import JUDGEMENTS, METRIC_ROWS, REQUESTS, SETTINGS
from relevanta.sources import files, named, results
from relevanta.sources.work import staged, work_path

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _written(lines: DataFrame, label: str) -> str:
    """The path of text files that hold the rows of a one-column table."""
    path = work_path(lines.sparkSession, label)
    lines.write.text(path)
    return path


@register(f"WITH {JUDGEMENTS} SELECT query::VARCHAR AS query, product::VARCHAR AS product, grade FROM judgements")
def read_judgements_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _written(t.judgements(spark, d).select(F.concat_ws("\u0001", "query", "product", F.lit("x"), F.lit("1"), "grade")), "judgements")
    return last_grades(files.read_judgements_csv(spark, path, "\u0001", 0, 1, 4, 5), "line_id")


@register(f"WITH {JUDGEMENTS} SELECT query::VARCHAR AS query, product::VARCHAR AS product, grade FROM judgements")
def read_judgements_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "judgements")
    products = F.collect_list(F.struct(F.col("product").cast("string").alias("productId"), F.col("grade").alias("score")))
    t.judgements(spark, d).groupBy(F.col("query").cast("string").alias("query")).agg(products.alias("products")).write.json(path)
    return files.read_judgements_jsonl(spark, path)


def _full(spark: SparkSession, d: str) -> DataFrame:
    rows = t.settings(spark, d).withColumns({"agg_type": F.lit("DOUBLE_AVG"), "weighted_fail_count": F.col("fail_count").cast("double")})
    none = F.create_map().cast("map<string,bigint>")
    return rows.withColumn("fail_reasons", F.when(F.col("fail_count") > 0, F.create_map(F.lit("FAILED"), F.col("fail_count"))).otherwise(none))


_TYPES = {"NDCG@4": "DOUBLE_AVG", "PRECISION@2": "DOUBLE_AVG", "RECALL@2": "DOUBLE_AVG"}
_ROWS = f"WITH {SETTINGS} SELECT params_key, metric, sum(success_count)::BIGINT AS success_count, sum(fail_count)::BIGINT AS fail_count, round(sum(value), 3) AS value FROM settings GROUP BY ALL"


def _totals(rows: DataFrame, value) -> DataFrame:
    return rows.groupBy("params_key", "metric").agg(F.sum("success_count").alias("success_count"), F.sum("fail_count").alias("fail_count"), F.round(F.sum(value), 3).alias("value"))


@register(_ROWS)
def read_results_csv(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "results")
    # six decimals here, so that sums agree; the documents' own four are the default of number formats
    results.write_results_csv(_full(spark, d), path, ["priority", "status"], _TYPES, decimals=6)
    return _totals(results.read_results_csv(spark, path, tag=F.col("tag")), F.col("value"))


@register(_ROWS)
def read_results_json(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "results")
    results.write_results_json(_full(spark, d), path)
    return _totals(results.read_results_json(spark, path), F.col("value"))


#: A metric of each type but the first, aggregated by its own type over the results of each tag and setting.
_DOCUMENT_TYPES = {"NDCG@4": "DOUBLE_AVG", "NATIONS": "MAP_UNWEIGHTED_SUM_VALUE", "WEIGHTS": "MAP_WEIGHTED_SUM_VALUE", "JUDGED": "NESTED_MAP_UNWEIGHTED_SUM_VALUE", "FIRST": "SEQUENCE_KEEP_FIRST"}


def _typed(spark: SparkSession, d: str) -> DataFrame:
    rows = staged(t.metric_rows(spark, d), "metric-rows")
    keys = ["tag", "params_key"]
    one = F.create_map("nation", F.lit(1.0))
    kinds = {
        "NDCG@4": {"value": F.col("value")}, "NATIONS": {"map_value": one}, "WEIGHTS": {"map_value": one}, "JUDGED": {"nested_value": F.create_map(F.lit("nation"), one)}, "FIRST": {"seq_value": F.array(F.col("query").cast("string"), "nation")},
    }
    columns = {"value": "double", "map_value": "map<string,double>", "nested_value": "map<string,map<string,double>>", "seq_value": "array<string>"}
    each = [F.struct(F.lit(m).alias("metric"), F.lit(_DOCUMENT_TYPES[m]).alias("agg_type"), *(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in columns.items())) for m, own in kinds.items()]
    ndcg = rows.filter("metric = 'NDCG@4'")
    wide = ndcg.select(*keys, "weight", F.col("query").alias("seq"), "reasons", F.explode(F.array(*each)).alias("m"))
    whole = aggregate_typed(wide.select(*keys, "weight", "seq", "reasons", "m.*"), [*keys, "metric"], F.col("weight"))
    context = ndcg.groupBy(*keys).agg(F.count("*").alias("rows")).select(*keys, carry_context("rows").alias("context_info"))
    split = F.transform_values(F.str_to_map("params_key", F.lit("&"), F.lit("=")), lambda _, v: F.array(v))
    return whole.join(context, keys).withColumn("params", split)


#: Tag, setting and metric with every value of the documents, long; the context comes as a metric of its own.
_DOCUMENTS = f"""WITH {METRIC_ROWS}, n AS (SELECT tag, params_key, query, nation, value, reason, weight FROM m WHERE metric = 'NDCG@4'), ok AS (SELECT * FROM n WHERE reason IS NULL),
    firsts AS (SELECT tag, params_key, min(query) AS q, arg_min(nation, query) AS nation FROM ok GROUP BY ALL)
    SELECT tag, params_key, 'NDCG@4' AS metric, '' AS "key", '' AS position, round(coalesce(sum(weight * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN weight END), 0), 0), 4) AS value FROM n GROUP BY tag, params_key
    UNION ALL SELECT tag, params_key, 'NATIONS', nation, '', count(*)::DOUBLE FROM ok GROUP BY tag, params_key, nation
    UNION ALL SELECT tag, params_key, 'WEIGHTS', nation, '', sum(weight)::DOUBLE FROM ok GROUP BY tag, params_key, nation
    UNION ALL SELECT tag, params_key, 'JUDGED', 'nation', nation, count(*)::DOUBLE FROM ok GROUP BY tag, params_key, nation
    UNION ALL SELECT tag, params_key, 'FIRST', nation, '', q::DOUBLE FROM firsts
    UNION ALL SELECT tag, params_key, 'CONTEXT', 'rows', '', count(*)::DOUBLE FROM n GROUP BY tag, params_key
    UNION ALL SELECT tag, params_key, 'REASONS', reason, '', count(*)::DOUBLE FROM n WHERE reason IS NOT NULL GROUP BY tag, params_key, reason"""


def _entries(rows: DataFrame) -> DataFrame:
    """Long rows of read documents as ``_DOCUMENTS`` has them."""
    entry = lambda k, p, v: F.struct(F.lit(None).cast("string").alias("metric"), k.alias("key"), p.alias("position"), v.alias("value"))
    nothing = F.lit("")
    flat = F.transform(F.map_entries("map_value"), lambda e: entry(e["key"], nothing, e["value"]))
    nested = F.flatten(F.transform(F.map_entries("nested_value"), lambda e: F.transform(F.map_entries(e["value"]), lambda x: entry(e["key"], x["key"], x["value"]))))
    sequence = F.when(F.size("seq_value") == 2, F.array(entry(F.get("seq_value", F.lit(1)), nothing, F.get("seq_value", F.lit(0)).try_cast("double"))))
    number = F.when(F.col("agg_type") == "DOUBLE_AVG", F.array(entry(nothing, nothing, F.round("value", 4))))
    named = lambda m, e: F.struct(m.alias("metric"), e["key"].alias("key"), e["position"].alias("position"), e["value"].alias("value"))
    own = F.transform(F.coalesce(number, flat, nested, sequence), lambda e: named(F.col("metric"), e))
    once = F.col("metric") == "NDCG@4"
    context = F.when(once, F.array(F.struct(F.lit("CONTEXT").alias("metric"), F.lit("rows").alias("key"), nothing.alias("position"), F.get_json_object("context_info", "$.rows").try_cast("double").alias("value"))))
    reasons = F.when(once, F.transform(F.map_entries("fail_reasons"), lambda e: F.struct(F.lit("REASONS").alias("metric"), e["key"].alias("key"), nothing.alias("position"), e["value"].cast("double").alias("value"))))
    none = F.array().cast("array<struct<metric:string,key:string,position:string,value:double>>")
    return rows.select("tag", "params_key", F.explode(F.concat(*(F.coalesce(x, none) for x in (own, context, reasons)))).alias("e")).select("tag", "params_key", "e.*")


@register(_DOCUMENTS)
def write_results_csv(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a metric of every kind of value, context and reasons, in parts of a few settings, read back."""
    path = work_path(spark, "results")
    results.write_results_csv(_typed(spark, d), path, ["priority", "status"], _DOCUMENT_TYPES, settings_per_part=4)
    return _entries(results.read_results_csv(spark, path, tag=F.col("tag")))


@register(_DOCUMENTS)
def write_results_json(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "results")
    results.write_results_json(_typed(spark, d), path, settings_per_part=4)
    return _entries(results.read_results_json(spark, path))


@register(_ROWS)
def write_results_by_tag(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "results")
    results.write_results_by_tag(_full(spark, d), path)
    return _totals(spark.read.parquet(path), F.col("value"))


@register(f"WITH {SETTINGS} SELECT DISTINCT metric, 'DOUBLE_AVG' AS agg_type FROM settings")
def read_metric_types(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "results")
    results.write_results_csv(_full(spark, d), path, ["priority", "status"], _TYPES)
    return results.read_metric_types(spark, path)


@register(SUMMARY)
def write_summary(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "job")
    summary = run_summary(t.settings(spark, d))
    results.write_summary(summary, path)
    return summary_columns(spark.read.schema(summary.schema).json(f"{path}/summary"))


@register("SELECT trim(p_name) AS value, count(*) AS n FROM part GROUP BY 1")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_name"), F.lit("# a comment"), F.lit(""))))
    return files.read_lines(spark, _written(part, "lines")).groupBy("value").agg(F.count("*").alias("n"))


@register("SELECT v AS value, count(*) AS n FROM (SELECT unnest([p_brand, p_type, p_name]) AS v FROM part) GROUP BY 1")
def read_split_values(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part").select(F.concat_ws(" , ", "p_brand", "p_type", "p_name"))
    return files.read_split_values(spark, _written(part, "values"), ",").groupBy("value").agg(F.count("*").alias("n"))


@register("SELECT DISTINCT p_type AS value FROM part")
def read_unique_column(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part").select(F.concat_ws("|", "p_partkey", "p_type"))
    return files.read_unique_column(spark, _written(part, "columns"), "|", 1)


def _people(spark: SparkSession, d: str, name: str = "supplier", column: str = "s_name", nation_key: str = "s_nationkey") -> DataFrame:
    """``name, nation``: each supplier (or customer) once."""
    nation = t.table(spark, d, "nation")
    rows = t.table(spark, d, name).join(nation, F.col(nation_key) == F.col("n_nationkey"))
    return rows.groupBy(F.col(column).alias("name")).agg(F.min("n_name").alias("nation"))


_PEOPLE = "p AS (SELECT s_name AS name, min(n_name) AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"
_CUSTOMERS = "c AS (SELECT c_name AS name, min(n_name) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"


@register(f'WITH {_PEOPLE} SELECT name AS "key", nation AS value FROM p')
def read_mapping_csv(spark: SparkSession, d: str) -> DataFrame:
    return files.read_mapping_csv(spark, _written(_people(spark, d).select(F.concat_ws(",", F.lit("x"), "name", "nation")), "mapping"), key=1, value=2)


@register(f"""WITH {_PEOPLE} SELECT nation AS "key", string_agg(name, '|' ORDER BY name) AS "values" FROM p GROUP BY 1""")
def read_mapping_csv_set(spark: SparkSession, d: str) -> DataFrame:
    rows = files.read_mapping_csv(spark, _written(_people(spark, d).select(F.concat_ws(",", "nation", "name")), "mapping"), mode="set")
    return rows.select("key", F.array_join("value", "|").alias("values"))


@register(f"""WITH {_PEOPLE} SELECT nation AS "key", string_agg(name, '|' ORDER BY name DESC) AS "values" FROM p GROUP BY 1""")
def read_mapping_csv_header(spark: SparkSession, d: str) -> DataFrame:
    """A key's values stand in one file, in falling order, and come back in that order."""
    path = work_path(spark, "mapping")
    rows = _people(spark, d).select(F.col("nation").alias("id"), F.col("name").alias("section"))
    rows.repartition("id").sortWithinPartitions("id", F.desc("section")).write.option("header", True).option("sep", ";").csv(path)
    return files.read_mapping_csv_header(spark, path, "id", "section", ";").select("key", F.array_join("values", "|").alias("values"))


@register(f'WITH {_PEOPLE} SELECT name AS "key", nation AS value FROM p')
def read_mapping_csv_meta(spark: SparkSession, d: str) -> DataFrame:
    lines = _people(spark, d).select(F.concat_ws("~", "name", "nation").alias("value"))
    head = t.table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("#delimiter=~").alias("value"))
    return files.read_mapping_csv_meta(spark, _written(head.unionByName(lines), "mapping"))


@register(f'WITH {_PEOPLE} SELECT nation AS "key", name AS value FROM p')
def read_mapping_json(spark: SparkSession, d: str) -> DataFrame:
    """One object a file, a file for a part of the keys."""
    path = work_path(spark, "mapping")
    entries = _people(spark, d).groupBy("nation").agg(F.array_sort(F.collect_list("name")).alias("v"))
    objects = entries.groupBy(F.pmod(F.hash("nation"), F.lit(8)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("nation", "v")))).alias("value"))
    objects.write.partitionBy("part").text(path)
    rows = files.read_mapping_json(spark, path, arrays=True)
    return rows.select("key", F.explode("value").alias("value"))


def _by_key(spark: SparkSession, people: DataFrame) -> str:
    """A folder with a file ``NATION.txt`` a nation that holds its people's names in order, one a line."""
    path = work_path(spark, "keys")
    named.write_named_files(people, path, "nation", "name", ["name"])
    return path


@register(f"""WITH {_CUSTOMERS} SELECT nation AS name, nation || '.txt' AS file, count(*) AS lines FROM c GROUP BY 1""")
def write_named_files(spark: SparkSession, d: str) -> DataFrame:
    """What the writer reports of the files it has published."""
    return named.write_named_files(_people(spark, d, "customer", "c_name", "c_nationkey"), work_path(spark, "named"), "nation", "name", ["name"])


@register(f"""WITH {_CUSTOMERS} SELECT nation AS "key", string_agg(name, '|' ORDER BY name) AS "values" FROM c GROUP BY 1""")
def read_key_by_filename(spark: SparkSession, d: str) -> DataFrame:
    rows = files.read_key_by_filename(spark, _by_key(spark, _people(spark, d, "customer", "c_name", "c_nationkey")))
    return rows.select("key", F.array_join("values", "|").alias("values"))


@register(f"""WITH {_PEOPLE}, {_CUSTOMERS} SELECT nation AS "key", 'supplier' AS param, string_agg(name, '|' ORDER BY name) AS "values" FROM p GROUP BY 1 UNION ALL SELECT nation, 'customer', string_agg(name, '|' ORDER BY name) FROM c GROUP BY 1""")
def read_param_dirs(spark: SparkSession, d: str) -> DataFrame:
    folders = {"supplier": _by_key(spark, _people(spark, d)), "customer": _by_key(spark, _people(spark, d, "customer", "c_name", "c_nationkey"))}
    return files.read_param_dirs(spark, folders).select("key", "param", F.array_join("values", "|").alias("values"))


@register(f"WITH {_CUSTOMERS} SELECT DISTINCT nation AS value FROM c")
def read_filename_keys(spark: SparkSession, d: str) -> DataFrame:
    return files.read_filename_keys(spark, _by_key(spark, _people(spark, d, "customer", "c_name", "c_nationkey")))


@register(f"WITH {_CUSTOMERS} SELECT nation || '.txt' AS name, sum(length(name) + 1)::BIGINT AS length FROM c WHERE nation LIKE 'NATION_1%' GROUP BY 1")
def list_results(spark: SparkSession, d: str) -> DataFrame:
    rows = files.list_results(spark, _by_key(spark, _people(spark, d, "customer", "c_name", "c_nationkey")), r"NATION_1.*\.txt")
    return rows.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "length")


@register(f"WITH {_PEOPLE} SELECT name AS value, 2::BIGINT AS n FROM p")
def object_store_paths(spark: SparkSession, d: str) -> DataFrame:
    """The same folder by its path as given and by a pattern below its store: readers take what Spark's readers take."""
    path = _written(_people(spark, d).select("name"), "lines")
    both = files.read_lines(spark, path).unionByName(files.read_lines(spark, f"{path}/part-*"))
    return both.groupBy("value").agg(F.count("*").alias("n"))


@register(f"WITH {_PEOPLE} SELECT name AS value FROM p")
def second_store(spark: SparkSession, d: str) -> DataFrame:
    """The folder through another file system of Hadoop's, a mount table that only this read knows."""
    path = _written(_people(spark, d).select("name"), "lines")
    return files.read_lines(spark, "viewfs://values/in", {"fs.viewfs.mounttable.values.link./in": path}).select("value")


@register(f"WITH {REQUESTS}, x AS (SELECT DISTINCT tag AS date, nation AS job FROM requests) SELECT date, string_agg(job, ',' ORDER BY job) AS jobs, string_agg(job, ',' ORDER BY job) FILTER (job < 'J') AS summarised FROM x GROUP BY 1")
def results_overview(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "overview")
    jobs = t.requests(spark, d).select(F.col("tag").alias("date"), F.col("nation").alias("job"), "query")
    jobs.repartition("date").write.partitionBy("date", "job").parquet(path)
    store = spark.read.parquet(path)
    rows = files.results_overview(store, store.filter("job < 'J'").select("date", "job").distinct())
    return rows.select("date", F.array_join("jobs", ",").alias("jobs"), F.array_join("summarised", ",").alias("summarised"))


@register("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id)[1:3], ',') AS first FROM events GROUP BY 1")
def sample_values(spark: SparkSession, d: str) -> DataFrame:
    types = t.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    return types.select("user_id", F.array_join(files.sample_values(F.col("types"), 3), ",").alias("first"))


@register(f"WITH {REQUESTS} SELECT query, 'priority=' || prio || '&status=' || stat AS shown FROM requests")
def params_text(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).select("query", text.params_key(F.col("params")).alias("shown"))
