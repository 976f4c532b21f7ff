"""Queries over aggregated settings: summaries, rankings, series; checks; fields out of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions import text
from relevanta.operators import checks, deep, extract, formats, gate, summary
from relevanta.operators.grid import numbered
from relevanta.plans import tables as t
from relevanta.plans.tables import METRIC_ROWS, SETTINGS
from relevanta.sources.work import staged, work_path

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_BUCKETS = f"""{SETTINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY tag, metric ORDER BY value DESC, params_key DESC) AS i FROM settings WHERE success_count > 0),
    b AS (SELECT tag, metric, i, params_key, prio, stat, value, value AS head, 0 AS bucket FROM o WHERE i = 1
        UNION ALL SELECT o.tag, o.metric, o.i, o.params_key, o.prio, o.stat, o.value, CASE WHEN b.head - o.value <= 0.01::DOUBLE THEN b.head ELSE o.value END, CASE WHEN b.head - o.value <= 0.01::DOUBLE THEN b.bucket ELSE b.bucket + 1 END
        FROM o JOIN b ON o.tag = b.tag AND o.metric = b.metric AND o.i = b.i + 1)"""


@register(f"WITH RECURSIVE {_BUCKETS} SELECT tag, metric, bucket::INT AS bucket, head AS bucket_value, params_key, value FROM b")
def group_similar_values(spark: SparkSession, d: str) -> DataFrame:
    return summary.group_similar_values(t.settings(spark, d).filter("success_count > 0"))


_ENDS = f"""{_BUCKETS}, ends AS (SELECT tag, metric, max(bucket) AS last FROM b GROUP BY ALL),
    firsts AS (SELECT b.*, row_number() OVER (PARTITION BY tag, metric, bucket ORDER BY params_key) AS k FROM b),
    bw AS (SELECT f.tag, f.metric, unnest(list_filter([CASE WHEN bucket = 0 THEN 'best' END, CASE WHEN bucket = last THEN 'worst' END], lambda x: x IS NOT NULL)) AS kind, params_key, head AS value FROM firsts f JOIN ends e ON f.tag = e.tag AND f.metric = e.metric WHERE k = 1)"""


@register(f"WITH RECURSIVE {_ENDS} SELECT tag, metric, kind, params_key, value FROM bw")
def best_worst_config(spark: SparkSession, d: str) -> DataFrame:
    return summary.best_worst_config(t.settings(spark, d))


_BY_PARAM = f"{SETTINGS}, live AS (SELECT * FROM settings WHERE success_count > 0), bp AS (SELECT tag, metric, 'priority' AS param, prio AS setting, stat AS rest, value FROM live UNION ALL SELECT tag, metric, 'status', stat, prio, value FROM live)"


@register(f"WITH {_BY_PARAM}, x AS (SELECT tag, metric, param, setting, quantile_cont(value, 0.5) AS v FROM bp GROUP BY ALL) SELECT tag, metric, param, round(max(v) - min(v), 6) AS median_shift FROM x GROUP BY ALL")
def max_median_shift(spark: SparkSession, d: str) -> DataFrame:
    return summary.max_median_shift(t.settings(spark, d)).withColumn("median_shift", F.round("median_shift", 6))


@register(f"WITH {_BY_PARAM}, x AS (SELECT tag, metric, param, rest, max(value) - min(value) AS v FROM bp GROUP BY ALL) SELECT tag, metric, param, round(max(v), 6) AS single_shift FROM x GROUP BY ALL")
def max_single_result_shift(spark: SparkSession, d: str) -> DataFrame:
    return summary.max_single_result_shift(t.settings(spark, d)).withColumn("single_shift", F.round("single_shift", 6))


#: Best and worst setting and all four effects of a tag and metric.
SUMMARY = f"""WITH RECURSIVE {_ENDS}, live AS (SELECT * FROM settings WHERE success_count > 0), bp AS (SELECT tag, metric, 'priority' AS param, prio AS setting, stat AS rest, value FROM live UNION ALL SELECT tag, metric, 'status', stat, prio, value FROM live),
    md AS (SELECT tag, metric, param, setting, quantile_cont(value, 0.5) AS v FROM bp GROUP BY ALL), sh AS (SELECT tag, metric, param, max(v) - min(v) AS s FROM md GROUP BY ALL),
    ss AS (SELECT tag, metric, param, max(d) AS s FROM (SELECT tag, metric, param, rest, max(value) - min(value) AS d FROM bp GROUP BY ALL) GROUP BY ALL),
    fx AS (SELECT tag, metric, round(max(CASE WHEN param = 'priority' THEN s END), 6) AS p, round(max(CASE WHEN param = 'status' THEN s END), 6) AS q FROM sh GROUP BY ALL), fy AS (SELECT tag, metric, round(max(CASE WHEN param = 'priority' THEN s END), 6) AS p, round(max(CASE WHEN param = 'status' THEN s END), 6) AS q FROM ss GROUP BY ALL)
    SELECT bw.tag, bw.metric, max(CASE WHEN kind = 'best' THEN params_key END) AS best, max(CASE WHEN kind = 'best' THEN value END) AS best_value, max(CASE WHEN kind = 'worst' THEN params_key END) AS worst, max(CASE WHEN kind = 'worst' THEN value END) AS worst_value,
    max(fx.p) AS priority_median, max(fx.q) AS status_median, max(fy.p) AS priority_single, max(fy.q) AS status_single FROM bw JOIN fx ON bw.tag = fx.tag AND bw.metric = fx.metric JOIN fy ON bw.tag = fy.tag AND bw.metric = fy.metric GROUP BY bw.tag, bw.metric"""


def summary_columns(rows: DataFrame) -> DataFrame:
    effect = lambda c, p: F.round(F.col(f"{c}_shift")[p], 6).alias(f"{p}_{c}")
    return rows.select("tag", "metric", "best", "best_value", "worst", "worst_value", *(effect(c, p) for c in ("median", "single") for p in ("priority", "status")))


@register(SUMMARY)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary_columns(summary.run_summary(t.settings(spark, d)))


_COST = "CASE WHEN p_size <> 0 THEN 1000 + p_size ELSE 0 END + CASE WHEN p_size % 7 <> 0 THEN 1000 + p_size % 7 ELSE 0 END"


@register(
    f"""WITH RECURSIVE s AS (SELECT p_brand AS tag, p_size % 7 AS depth, p_size AS size, 'depth=' || p_size % 7 || '&size=' || p_size AS params_key, {_COST} AS cost, round(avg(p_retailprice) / 1000.0, 2) AS value FROM part GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY value DESC, params_key DESC) AS i FROM s),
    b AS (SELECT tag, i, params_key, cost, value, value AS head, 0 AS bucket FROM o WHERE i = 1
        UNION ALL SELECT o.tag, o.i, o.params_key, o.cost, o.value, CASE WHEN b.head - o.value <= 0.05::DOUBLE THEN b.head ELSE o.value END, CASE WHEN b.head - o.value <= 0.05::DOUBLE THEN b.bucket ELSE b.bucket + 1 END FROM o JOIN b ON o.tag = b.tag AND o.i = b.i + 1),
    e AS (SELECT tag, max(bucket) AS last FROM b GROUP BY 1), f AS (SELECT b.*, row_number() OVER (PARTITION BY tag, bucket ORDER BY cost, params_key) AS k FROM b)
    SELECT f.tag, 'price' AS metric, unnest(list_filter([CASE WHEN bucket = 0 THEN 'best' END, CASE WHEN bucket = last THEN 'worst' END], lambda x: x IS NOT NULL)) AS kind, params_key, head AS value FROM f JOIN e ON f.tag = e.tag WHERE k = 1"""
)
def param_tie_break(spark: SparkSession, d: str) -> DataFrame:
    """Settings with two numeric parameters: among those of a bucket the cheapest stands for it."""
    number = lambda c: F.array(c.cast("string"))
    params = F.create_map(F.lit("size"), number(F.col("size")), F.lit("depth"), number(F.col("depth")))
    rows = t.table(spark, d, "part").groupBy(F.col("p_brand").alias("tag"), F.col("p_size").alias("size"), (F.col("p_size") % 7).alias("depth")).agg(F.round(F.avg("p_retailprice") / 1000.0, 2).alias("value"), F.count("*").alias("success_count"))
    rows = rows.select("tag", F.lit("price").alias("metric"), params.alias("params"), text.params_key(params).alias("params_key"), "value", "success_count")
    return summary.best_worst_config(rows, 0.05)


@register(
    f"""WITH {_BY_PARAM}, md AS (SELECT tag, metric, param, setting, quantile_cont(value, 0.5) AS v FROM bp GROUP BY ALL), x AS (SELECT tag, metric, 'median_shift' AS measure, param, max(v) - min(v) AS s FROM md GROUP BY ALL
        UNION ALL SELECT tag, metric, 'single_shift', param, max(d) FROM (SELECT tag, metric, param, rest, max(value) - min(value) AS d FROM bp GROUP BY ALL) GROUP BY ALL)
    SELECT tag, metric, measure, printf('%.4f', max(CASE WHEN param = 'priority' THEN s END)) AS priority, printf('%.4f', max(CASE WHEN param = 'status' THEN s END)) AS status FROM x GROUP BY ALL"""
)
def summary_effect_matrix(spark: SparkSession, d: str) -> DataFrame:
    return summary.summary_effect_matrix(summary.run_summary(t.settings(spark, d)), ["priority", "status"])


@register(f"WITH RECURSIVE {_ENDS} SELECT tag, metric, CASE kind WHEN 'best' THEN 'winner' ELSE 'loser' END AS kind, params_key, value FROM bw")
def summary_winner_loser(spark: SparkSession, d: str) -> DataFrame:
    return summary.summary_winner_loser(summary.run_summary(t.settings(spark, d)))


_NOW = "priority=1-URGENT&status=F"
_CHANGE = f"{SETTINGS}, ch AS (SELECT s.tag, s.metric, s.params_key, round(s.value - c.value, 6) AS change FROM settings s JOIN settings c ON s.tag = c.tag AND s.metric = c.metric AND c.params_key = '{_NOW}' WHERE s.params_key <> '{_NOW}')"


@register(f"WITH {_CHANGE} SELECT * FROM ch")
def improving_losing(spark: SparkSession, d: str) -> DataFrame:
    return summary.improving_losing(t.settings(spark, d), _NOW).withColumn("change", F.round("change", 6))


@register(
    f"""WITH {_CHANGE}, hi AS (SELECT *, row_number() OVER (PARTITION BY metric, params_key ORDER BY change DESC, tag) AS r FROM ch), lo AS (SELECT *, row_number() OVER (PARTITION BY metric, params_key ORDER BY change, tag) AS r FROM ch)
    SELECT tag, metric, params_key, change, r::INT AS rank, 'best' AS kind FROM hi WHERE r <= 2 UNION ALL SELECT tag, metric, params_key, change, r::INT, 'worst' FROM lo WHERE r <= 1"""
)
def top_bottom_per_setting(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_bottom_per_setting(summary.improving_losing(t.settings(spark, d), _NOW).withColumn("change", F.round("change", 6)), 2, 1)


@register(f"WITH {METRIC_ROWS}, x AS (SELECT nation || ' ' || query % 50 AS tag, bool_or(params_key = '{_NOW}') AS a, bool_or(params_key <> '{_NOW}') AS b FROM m GROUP BY 1) SELECT tag, CASE WHEN NOT a THEN 'NO_CURRENT_VALUE' ELSE 'NO_COMPARISON_VALUE' END AS reason FROM x WHERE NOT (a AND b)")
def uncompared_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = t.metric_rows(spark, d).withColumn("tag", F.concat("nation", F.lit(" "), (F.col("query") % 50).cast("string")))
    return summary.uncompared_queries(rows, _NOW)


@register(f"WITH {SETTINGS} SELECT tag, metric, round(var_pop(value), 6) AS variance, count(*) AS settings FROM settings GROUP BY ALL")
def query_metric_variance(spark: SparkSession, d: str) -> DataFrame:
    return summary.query_metric_variance(t.settings(spark, d)).withColumn("variance", F.round("variance", 6))


@register(f"WITH {SETTINGS} SELECT tag, params_key, value FROM settings WHERE metric = 'NDCG@4' ORDER BY value DESC, tag, params_key LIMIT 20")
def sort_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return summary.sort_by_metric(t.settings(spark, d), "NDCG@4", 20).select("tag", "params_key", "value")


@register(f"""WITH {SETTINGS} SELECT tag AS segment, params_key, max(CASE WHEN metric = 'NDCG@4' THEN value END) AS "value-NDCG@4", max(CASE WHEN metric = 'RECALL@2' THEN value END) AS "value-RECALL@2" FROM settings GROUP BY ALL""")
def select_params_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = ["NDCG@4", "RECALL@2"]
    wide = t.settings(spark, d).groupBy(F.col("tag").alias("segment"), "params_key").pivot("metric", names).agg(F.max("value").alias("value"), F.max("fail_count").alias("fail"))
    wide = wide.withColumnsRenamed({f"{m}_value": f"value-{m}" for m in names} | {f"{m}_fail": f"fail-count-{m}" for m in names})
    return summary.select_params_metrics(wide, ["segment", "params_key"])


@register(f"WITH {SETTINGS} SELECT tag, 'priority__' || prio || '|status__' || stat AS label, value FROM settings WHERE metric = 'NDCG@4'")
def metric_series(spark: SparkSession, d: str) -> DataFrame:
    return summary.metric_series(t.settings(spark, d), "NDCG@4")


_EVENTS = 'e AS (SELECT user_id % 4 AS mode, event_type AS "key", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events)'


@register(f"""WITH {_EVENTS} SELECT mode, position::INT AS position, count(*)::DOUBLE AS n FROM e WHERE "key" = 'click' AND position < 6 GROUP BY ALL""")
def histogram_series(spark: SparkSession, d: str) -> DataFrame:
    from relevanta.functions import ranking
    from relevanta.operators.aggregate import agg_nested_map_sum

    types = t.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    rows = types.select((F.col("user_id") % 4).alias("mode"), ranking.position_histogram(F.col("types"), 6).alias("h"))
    return summary.histogram_series(agg_nested_map_sum(rows, ["mode"], "h"), "click", ["mode"])


@register(f"WITH {SETTINGS}, s AS (SELECT tag AS series, params_key AS label, sum(fail_count)::DOUBLE AS value FROM settings GROUP BY ALL HAVING sum(fail_count) > 0) SELECT a.series, b.label, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT series FROM s) a CROSS JOIN (SELECT DISTINCT label FROM s) b LEFT JOIN s ON s.series = a.series AND s.label = b.label")
def align_series(spark: SparkSession, d: str) -> DataFrame:
    rows = t.settings(spark, d).groupBy(F.col("tag").alias("series"), F.col("params_key").alias("label")).agg(F.sum("fail_count").cast("double").alias("value")).filter("value > 0")
    return summary.align_series(rows)


@register("WITH x AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS v FROM part) SELECT v, row_number() OVER (ORDER BY try_cast(v AS DOUBLE) NULLS LAST, v)::INT AS pos FROM x")
def number_aware_sort(spark: SparkSession, d: str) -> DataFrame:
    values = t.table(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("v")).distinct()
    return numbered(values, text.number_aware_order(F.col("v")), "pos").select("v", (F.col("pos") + 1).cast("int").alias("pos"))


@register(f"WITH {METRIC_ROWS} SELECT nation AS query, count(*) AS n FROM m GROUP BY 1")
def query_from_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = t.metric_rows(spark, d).withColumn("tag", F.concat(text.single_tag("q", F.col("nation")), F.lit("-x1")))
    return rows.groupBy(text.param_in_tag(F.col("tag"), "q", "none").alias("query")).agg(F.count("*").alias("n"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """``query, response``: an order's lines as the documents of a search response."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"))), lambda x: F.struct(x["l_partkey"].cast("string").alias("product_id"), x["l_quantity"].alias("q"), F.struct(x["l_suppkey"].alias("sid")).alias("supplier")))
    body = F.to_json(F.struct(F.struct(F.count("*").alias("numFound"), docs.alias("docs")).alias("response")))
    return t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(body.alias("response"))


@register("SELECT event_id, (props->>'k')::INT AS k FROM events")
def extract_plain(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("event_id", extract.extract_plain(F.col("props"), ["k"], "INT").alias("k"))


_DOCS = "SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)::INT AS pos"


@register(f"{_DOCS}, l_partkey::VARCHAR AS product FROM lineitem")
def extract_plain_rec(spark: SparkSession, d: str) -> DataFrame:
    found = deep.extract_deep(_responses(spark, d), ["query"], "response", {"product": (r"\ response \ docs \\ product_id", "STRING")})
    rows = found.select("query", F.posexplode("product").alias("pos", "product"))
    return rows.withColumn("pos", F.col("pos") + 1)


@register(f"{_DOCS}, l_quantity AS q FROM lineitem")
def extract_recursive(spark: SparkSession, d: str) -> DataFrame:
    rows = _responses(spark, d).select("query", F.posexplode(extract.extract_any(F.col("response"), r"\\ q", "DOUBLE")).alias("pos", "q"))
    return rows.withColumn("pos", F.col("pos") + 1)


@register(f"{_DOCS}, l_suppkey::INT AS sid FROM lineitem")
def extract_rec_plain(spark: SparkSession, d: str) -> DataFrame:
    found = deep.extract_deep(_responses(spark, d), ["query"], "response", {"sid": (r"\\ supplier \ sid", "INT")})
    rows = found.select("query", F.posexplode("sid").alias("pos", "sid"))
    return rows.withColumn("pos", F.col("pos") + 1)


@register(f"{_DOCS}, l_suppkey::INT AS sid FROM lineitem")
def extract_rec_rec(spark: SparkSession, d: str) -> DataFrame:
    found = deep.extract_deep(_responses(spark, d), ["query"], "response", {"sid": (r"\\ docs \\ sid", "INT")})
    rows = found.select("query", F.posexplode("sid").alias("pos", "sid"))
    return rows.withColumn("pos", F.col("pos") + 1)


@register("SELECT l_orderkey AS query, count(*)::INT AS found, count(*)::INT AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = {"found": (r"\ response \ numFound", "INT"), "ids": (r"\ response \ docs \\ product_id", "STRING"), "qs": (r"\ response \ docs \\ q", "DOUBLE")}
    rows = extract.extract_fields(_responses(spark, d), "response", fields, direct=("ids", "qs"))
    return rows.select("query", "found", F.size("ids").alias("n"), F.aggregate("qs", F.lit(0.0), lambda s, x: s + x).alias("q"))


@register("SELECT p_partkey, try_cast(CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS INT) AS v FROM part")
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return t.table(spark, d, "part").select("p_partkey", extract.typed_cast(value, "INT").alias("v"))


@register("SELECT event_id, regexp_extract(props, '\"k\"\\s*:\\s*\"?([0-9]+)', 1) AS k FROM events")
def regex_field_values(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").select("event_id", text.first_field_value(F.col("props"), "k").alias("k"))


@register(
    """SELECT o_orderkey, o_totalprice, concat_ws('; ', CASE WHEN NOT (o_totalprice >= 1000 AND o_totalprice <= 400000) THEN 'o_totalprice: out of range' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'o_orderstatus: not a choice' END,
    CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-3]-.*') THEN 'o_orderpriority: no match' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: unknown condition' END, CASE WHEN o_orderstatus = 'F' AND NOT o_totalprice <= 250000 THEN 'o_orderstatus=F, o_totalprice: out of range' END) AS invalid FROM orders"""
)
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    rules = [checks.rule_between("o_totalprice", 1000, 400000), checks.rule_choice("o_orderstatus", ["F", "O"]), checks.rule_regex("o_orderpriority", "[1-3]-.*"), *checks.rule_conditional("o_orderstatus", {"F": [checks.rule_between("o_totalprice", high=250000)], "O": []})]
    return checks.validate_records(t.table(spark, d, "orders"), rules).select("o_orderkey", "o_totalprice", F.array_join("invalid", "; ").alias("invalid"))


@register("""WITH l AS (SELECT l_orderkey, bool_or(NOT l_quantity BETWEEN 2 AND 49) AS q, bool_or(l_returnflag = 'R') AS f, bool_or(l_linenumber > 5) AS n, bool_or(l_shipdate < DATE '1994-01-01') AS early FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey, min({'s': o_orderstatus, 't': o_totalprice, 'p': o_orderpriority}) AS x FROM orders GROUP BY 1), y AS (SELECT o_orderkey, x.s AS s, x.t AS t, x.p AS p, l.* FROM o LEFT JOIN l ON l_orderkey = o_orderkey)
    SELECT o_orderkey, array_to_string(list_sort(list_filter([
        CASE WHEN t < 1000 OR t > 400000 THEN 'total: out of range' END, CASE WHEN s NOT IN ('F', 'O') THEN 'status: not a choice' END, CASE WHEN NOT regexp_full_match(p, '[1-3]-.*') THEN 'priority: no match' END,
        CASE WHEN s NOT IN ('F', 'O') THEN 'note_[FO]: missing' END, CASE WHEN s NOT IN ('F', 'O') THEN 'status: unknown condition' END, CASE WHEN s = 'F' AND t > 250000 THEN 'total: out of range' END,
        CASE WHEN l_orderkey IS NULL THEN 'lines: missing' END, CASE WHEN q THEN 'lines[].quantity: out of range' END, CASE WHEN f THEN 'lines[].flag: not a choice' END, CASE WHEN n THEN 'lines[].tags{}: key' END, CASE WHEN n THEN 'lines[].tags{}: out of range' END, CASE WHEN early THEN 'lines[].when: none of 2' END
    ], lambda v: v IS NOT NULL).list_distinct()), '; ') AS invalid FROM y""")
def validate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON records against a tree of formats: types, patterns, choices, ranges, arrays, maps, alternatives, names by
    pattern, and fields that depend on another one."""
    line = F.struct(
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
        F.create_map(F.when(F.col("l_linenumber") > 5, "LATE").otherwise("n"), F.col("l_linenumber")).alias("tags"),
        F.when(F.col("l_shipdate") >= "1994-01-01", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("long ago").alias("when"),
    )
    # a line becomes text where it is read, so that only its text is sorted and shuffled
    texts = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_json(line).alias("line"))
    lines = texts.groupBy("o_orderkey").agg(F.concat(F.lit(',"lines":['), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("lines"))
    orders = t.table(spark, d, "orders").groupBy("o_orderkey").agg(F.min(F.struct("o_orderstatus", "o_totalprice", "o_orderpriority")).alias("o"))
    head = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o.o_orderstatus").alias("status"), F.col("o.o_totalprice").alias("total"), F.col("o.o_orderpriority").alias("priority")))
    note = F.concat(F.lit('{"note_'), "o.o_orderstatus", F.lit('":"'), "o.o_orderpriority", F.lit('",'))
    document = F.concat(note, F.substr(head, F.lit(2), F.length(head) - 2), F.coalesce("lines", F.lit("")), F.lit("}"))
    documents = orders.join(lines, "o_orderkey", "left").select("o_orderkey", document.alias("document"))
    each_line = formats.Record([
        formats.Field("part", formats.typed("int")), formats.Field("quantity", formats.between(2, 49)), formats.Field("flag", formats.choice(["N", "A"])),
        formats.Field("tags", formats.Entries(lambda k: k.rlike("^[a-z]+$"), formats.between(1, 5, "int"))),
        formats.Field("when", formats.Either([formats.regex(r"199[4-9]-\d\d-\d\d|2.*"), formats.typed("int")])), formats.Field("comment", formats.typed("string"), required=False),
    ])
    whole = formats.Record(
        [formats.Field("id", formats.typed("int")), formats.Field("status", formats.choice(["F", "O"])), formats.Field("total", formats.between(1000, 400000)), formats.Field("priority", formats.regex("[1-3]-.*")), formats.Field("note_[FO]", formats.typed("string"), pattern=True), formats.Field("lines", formats.Each(each_line))],
        {"status": {"F": [formats.Field("total", formats.between(high=250000))], "O": []}},
    )
    return documents.select("o_orderkey", F.array_join(formats.invalid_parts(F.col("document"), whole), "; ").alias("invalid"))


@register(f"WITH {METRIC_ROWS} SELECT query % 40 AS batch_nr, count(*) AS n, count(*) FILTER (value IS NULL) AS fails, NOT (count(*) > 10 AND count(*) FILTER (value IS NULL) / count(*) > 0.3::DOUBLE) AS passed FROM m GROUP BY 1")
def fail_fraction_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = t.metric_rows(spark, d).withColumn("batch_nr", F.col("query") % 40)
    return checks.fail_fraction_gate(rows, F.size("reasons") > 0, 0.3, 10)


@register(f"WITH {METRIC_ROWS} SELECT tag, count(*) FILTER (value IS NULL) > 0.33::DOUBLE * count(*) AS stopped FROM m GROUP BY 1")
def stop_on_failures(spark: SparkSession, d: str) -> DataFrame:
    """Each tag's rows as a batch that is written unless more than a third of it fails."""
    rows = staged(t.metric_rows(spark, d), "batches")
    sizes = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count("*").alias("n")).collect()}
    path = work_path(spark, "gated")
    ends = [(tag, gate.write_while_good(rows.filter(F.col("tag") == tag), F.size("reasons") > 0, f"{path}/{i}", 0.33, n)["stopped"]) for i, (tag, n) in enumerate(sorted(sizes.items()))]
    return spark.createDataFrame(ends, "tag string, stopped boolean")


@register("SELECT n_name AS class, (n_nationkey * 10)::BIGINT AS expected, count(c_custkey) AS n, count(c_custkey) >= n_nationkey * 10 AS passed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def class_count_gate(spark: SparkSession, d: str) -> DataFrame:
    nation = t.table(spark, d, "nation")
    rows = t.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return checks.class_count_gate(rows, "n_name", nation.select(F.col("n_name").alias("class"), (F.col("n_nationkey") * 10).cast("long").alias("expected")))


@register("WITH x AS (SELECT p_partkey, min(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'only left' WHEN p_partkey % 7 = 0 THEN 'v' END AS faults FROM x WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0")
def tables_equal_within(spark: SparkSession, d: str) -> DataFrame:
    left = t.table(spark, d, "part").groupBy("p_partkey").agg(F.min("p_retailprice").alias("v"))
    right = left.filter("p_partkey % 11 <> 0").withColumn("v", F.col("v") + F.when(F.col("p_partkey") % 7 == 0, 0.5).otherwise(1e-9))
    return checks.table_differences(left, right, ["p_partkey"]).select("p_partkey", F.array_join("faults", ",").alias("faults"))
