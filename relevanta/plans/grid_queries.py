"""Queries over parameter grids, conditional values, batches and requests; the streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevanta.functions import text
from relevanta.operators import conditional, grid, requests
from relevanta.plans import tables as t
from relevanta.plans.tables import METRIC_ROWS, REQUESTS

QUERIES, ORACLES = {}, {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _values(spark: SparkSession, d: str, name: str, column: str, where: str = "true") -> DataFrame:
    """``(pos, value)``: a column's distinct values in order."""
    rows = t.table(spark, d, name).filter(where).select(F.col(column).cast("string").alias("value")).distinct()
    return grid.numbered(rows, ["value"], "pos").select("pos", "value")


def _v(alias: str, name: str, column: str, where: str = "true") -> str:
    return f"{alias} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos FROM (SELECT DISTINCT {column}::VARCHAR AS value FROM {name} WHERE {where}))"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"brand": _values(spark, d, "part", "p_brand"), "priority": _values(spark, d, "orders", "o_orderpriority"), "type": _values(spark, d, "part", "p_type")}


_V3 = f"{_v('b', 'part', 'p_brand')}, {_v('p', 'orders', 'o_orderpriority')}, {_v('ty', 'part', 'p_type')}"
_GRID = f"{_V3}, g AS (SELECT b.pos + (SELECT count(*) FROM b) * (p.pos + (SELECT count(*) FROM p) * ty.pos) AS idx, b.value AS brand, p.value AS priority, ty.value AS type FROM b, p, ty)"


@register("WITH m AS (SELECT max(p_size) AS n FROM part) SELECT i AS pos, 0.5 + i * 0.25::DOUBLE AS value FROM (SELECT unnest(range(0, CAST(floor(n / 0.25) AS BIGINT) - 1)) AS i FROM m)")
def range_values(spark: SparkSession, d: str) -> DataFrame:
    most = t.table(spark, d, "part").agg(F.max("p_size").alias("n")).first()["n"]
    return grid.range_values(spark, 0.5, float(most), 0.25)


@register("WITH x AS (SELECT p_brand AS value, min(p_partkey) AS first_at FROM part GROUP BY 1) SELECT row_number() OVER (ORDER BY first_at) - 1 AS pos, value FROM x")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return grid.distinct_values(t.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("value")))


@register(f"WITH {_GRID} SELECT * FROM g")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.table_grid(_tables(spark, d))


@register(f"WITH {_GRID} SELECT * FROM g WHERE idx BETWEEN 17 AND 140")
def grid_slice(spark: SparkSession, d: str) -> DataFrame:
    return grid.table_grid(_tables(spark, d), 17, 141)


@register(f"WITH {_GRID} SELECT * FROM g WHERE idx = 42")
def grid_nth(spark: SparkSession, d: str) -> DataFrame:
    return grid.table_grid(_tables(spark, d), 42, 43)


@register(f"WITH {_V3} SELECT p_partkey, b.pos::INT AS brand_pos, ty.pos::INT AS type_pos, (b.pos + (SELECT count(*) FROM b) * ty.pos)::BIGINT AS idx FROM part JOIN b ON p_brand = b.value JOIN ty ON p_type = ty.value")
def grid_index_of(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    sizes = [tables["brand"].count(), tables["type"].count()]
    rows = t.table(spark, d, "part").join(tables["brand"].select(F.col("value").alias("p_brand"), F.col("pos").alias("b")), "p_brand").join(tables["type"].select(F.col("value").alias("p_type"), F.col("pos").alias("t")), "p_type")
    rows = rows.select("p_partkey", grid.index_of([F.col("b"), F.col("t")], sizes).alias("idx"))
    brand, kind = grid.digits(F.col("idx"), sizes)
    return rows.select("p_partkey", brand.alias("brand_pos"), kind.alias("type_pos"), "idx")


@register(f"WITH {_V3} SELECT (SELECT count(*) FROM b) * (SELECT count(*) FROM p) * (SELECT count(*) FROM ty) AS n")
def grid_size(spark: SparkSession, d: str) -> DataFrame:
    counts = [v.agg(F.count("*").alias("n")) for v in _tables(spark, d).values()]
    return grid.grid_sizes(counts)


@register(f"WITH {_V3} SELECT b.pos, b.value AS brand, ty.value AS type FROM b JOIN ty ON b.pos = ty.pos")
def grid_zip(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    return grid.grid_zip({"brand": tables["brand"], "type": tables["type"]})


@register(f"WITH {_V3} SELECT pos, 0 AS \"group\", value FROM b UNION ALL SELECT pos + (SELECT count(*) FROM b), 1, value FROM ty")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    return grid.ordered_union([tables["brand"], tables["type"]])


@register(f"WITH {_GRID} SELECT idx, upper(brand) || ':' || length(type) AS mapped FROM g")
def grid_map(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid_map(grid.table_grid(_tables(spark, d)), F.concat(F.upper("brand"), F.lit(":"), F.length("type").cast("string")))


@register(f"""WITH {_v('b', 'part', 'p_brand')}, {_v('s', 'customer', 'c_mktsegment')}, {_v('r', 'region', 'r_name')}, {_v('p', 'orders', 'o_orderpriority')}, {_v('f', 'lineitem', 'l_returnflag')}, {_v('st', 'orders', 'o_orderstatus')},
    n AS (SELECT (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM s) AS s, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM f) AS f)
    SELECT b.pos + n.b * (s.pos + n.s * (r.pos + n.r * (p.pos + n.p * (f.pos + n.f * st.pos)))) AS idx, '/search?brand=' || replace(replace(b.value, '#', p.value), ' ', '+') || '&rows=10' AS url,
    'accept=json,' || f.value || ';segment=' || s.value AS header, '{{"status":"' || st.value || '","in":"' || r.value || '"}}' AS body FROM b, s, r, p, f, st, n""")
def request_permutation(spark: SparkSession, d: str) -> DataFrame:
    """All six dimensions, and two without values, which are left out."""
    v = lambda *x: _values(spark, d, *x)
    bodies = v("orders", "o_orderstatus").withColumn("value", F.concat(F.lit('{"status":"'), "value", F.lit('","in":"$region"}')))
    dims = {
        "params": {"brand": v("part", "p_brand"), "nothing": v("part", "p_brand", "false")},
        "headers": {"segment": v("customer", "c_mktsegment"), "none": v("customer", "c_mktsegment", "false")},
        "body_replacements": {"$region": v("region", "r_name")},
        "url_replacements": {"#": v("orders", "o_orderpriority")},
        "header_replacements": {"$flag": v("lineitem", "l_returnflag")},
        "bodies": {"": bodies},
    }
    fixed = F.create_map(F.lit("rows"), F.array(F.lit("10")))
    accept = F.create_map(F.lit("accept"), F.array(F.lit("json"), F.lit("$flag")))
    rows = requests.request_permutation(spark, "search", dims, fixed=fixed, fixed_headers=accept)
    header = F.array_join(F.transform(F.array_sort(F.map_entries("request_headers")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return rows.select("idx", "url", header.alias("header"), F.col("request_body").alias("body"))


@register(f"WITH {_GRID}, x AS (SELECT brand, type, min(idx) AS first_at FROM g GROUP BY ALL) SELECT row_number() OVER (ORDER BY first_at) - 1 AS idx, brand, type FROM x")
def grid_add_remove(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    return grid.remove_param(grid.table_grid(tables), {n: v.count() for n, v in tables.items()}, "priority")


@register(f"WITH {_GRID} SELECT idx, brand || '/' || type || '@' || priority AS request FROM g")
def grid_merge(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    pairs = grid.grid_merge(tables["brand"], tables["priority"], lambda b, p: F.struct(b.alias("b"), p.alias("p")))
    merged = grid.grid_merge(pairs, tables["type"], lambda x, t_: F.concat(x["b"], F.lit("/"), t_, F.lit("@"), x["p"]))
    return merged.select(F.col("pos").alias("idx"), F.col("value").alias("request"))


@register(f"WITH {_GRID} SELECT idx, 'p=' || least(brand, type) || '&p=' || greatest(brand, type) || '&q=' || priority AS params_key FROM g")
def name_value_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.name_value_maps(grid.table_grid(_tables(spark, d)), [("brand", "p"), ("priority", "q"), ("type", "p")])
    return rows.select("idx", text.params_key(F.col("params")).alias("params_key"))


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation, region, supplier = (t.table(spark, d, n) for n in ("nation", "region", "supplier"))
    keys = region.select(F.col("r_name").alias("region"))
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("key"), F.col("n_name").alias("value"))
    suppliers = supplier.filter("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), F.col("s_name").alias("value"))
    return keys, nations, suppliers


@register("SELECT r_name AS region, n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def mapped_values(spark: SparkSession, d: str) -> DataFrame:
    keys, nations, suppliers = _regions(spark, d)
    return grid.mapped_values(keys, "region", [("nation", nations, "region"), ("supplier", suppliers, "nation")]).select("region", "nation", "supplier")


@register("SELECT n_name AS nation FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def prune_unmapped_keys(spark: SparkSession, d: str) -> DataFrame:
    nation = t.table(spark, d, "nation")
    rich = t.table(spark, d, "customer").filter("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"))
    return grid.prune_unmapped_keys(nation.select(F.col("n_name").alias("nation")), "nation", [_regions(spark, d)[2], rich])


@register("WITH p AS (SELECT s_nationkey AS k, s_name AS v FROM supplier WHERE s_acctbal > 5000), h AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 9500) SELECT n_nationkey AS nation, p.v AS param, h.v AS header FROM nation LEFT JOIN p ON p.k = n_nationkey LEFT JOIN h ON h.k = n_nationkey WHERE p.v IS NOT NULL OR h.v IS NOT NULL")
def key_mapped_permutations(spark: SparkSession, d: str) -> DataFrame:
    keys = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    params = t.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("value"))
    headers = t.table(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return grid.key_mapped_permutations(keys, "nation", {"param": params, "header": headers}).select("nation", "param", "header")


@register("SELECT s_suppkey AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def key_remap(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    remap = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"))
    regions = t.table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return grid.key_remap(rows, "nation", remap, regions, "region").select("supplier", "region")


@register(f"WITH {_GRID} SELECT g.idx, p.pos AS batch_nr FROM g JOIN p ON g.priority = p.value")
def batch_by_param(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    return grid.batch_by_param(grid.table_grid(tables), "priority", tables["priority"]).select("idx", "batch_nr")


@register(f"WITH {_GRID} SELECT idx // 37 AS batch_nr, count(*) AS n FROM g GROUP BY 1")
def batch_by_size(spark: SparkSession, d: str) -> DataFrame:
    return grid.batch_by_size(grid.table_grid(_tables(spark, d)), 37).groupBy("batch_nr").agg(F.count("*").alias("n"))


@register(f"WITH {_GRID}, s AS (SELECT ceil(count(*) / 7)::BIGINT AS size FROM g) SELECT idx // size AS batch_nr, count(*) AS n FROM g, s GROUP BY 1")
def batch_at_most(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d)
    total = grid.grid_size([v.count() for v in tables.values()])
    return grid.batch_at_most(grid.table_grid(tables), 7, total).groupBy("batch_nr").agg(F.count("*").alias("n"))


def _places(rows: DataFrame) -> DataFrame:
    """``key, pos, value`` of mapped values that are in the order of their text."""
    return rows.select("key", F.lit(0).cast("long").alias("pos"), "value").distinct()


def _conditional(spark: SparkSession, d: str) -> conditional.ConditionalGrid:
    """Regions have nations, which have suppliers, and segments; ragged at every level, with dead ends."""
    _, nations, suppliers = _regions(spark, d)
    nation, region = t.table(spark, d, "nation"), t.table(spark, d, "region")
    rich = t.table(spark, d, "customer").filter("c_acctbal > 9800").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    segments = rich.select(F.col("r_name").alias("key"), F.concat_ws("/", "c_mktsegment", F.left("n_name", F.lit(1))).alias("value"))
    mappings = [("nation", _places(nations), "region"), ("supplier", _places(suppliers), "nation"), ("segment", _places(segments), "region")]
    return conditional.conditional_grid(_values(spark, d, "region", "r_name"), "region", mappings)


_CONDITIONAL = """s AS (SELECT DISTINCT r_name, c_mktsegment || '/' || n_name[1] AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9800),
    n AS (SELECT DISTINCT r_name, n_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0),
    whole AS (SELECT row_number() OVER (ORDER BY r_name, segment, n_name, s_name) - 1 AS idx, r_name AS region, n_name AS nation, s_name AS supplier, segment FROM n JOIN s USING (r_name))"""


@register(f"WITH {_CONDITIONAL} SELECT count(*) AS n FROM whole")
def conditional_size(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d).size()


@register(f"WITH {_CONDITIONAL} SELECT * FROM whole")
def conditional_grid(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d).slice(spark)


@register(f"WITH {_CONDITIONAL} SELECT * FROM whole WHERE idx BETWEEN (SELECT count(*) // 3 FROM whole) AND (SELECT count(*) // 2 FROM whole)")
def conditional_slice(spark: SparkSession, d: str) -> DataFrame:
    """The middle of the grid, from a third to a half of its ranks."""
    grid_ = _conditional(spark, d)
    n = grid_.count()
    return grid_.slice(spark, n // 3, n // 2 + 1)


@register(f"WITH {_CONDITIONAL} SELECT * FROM whole WHERE idx = (SELECT count(*) * 3 // 4 FROM whole)")
def conditional_nth(spark: SparkSession, d: str) -> DataFrame:
    grid_ = _conditional(spark, d)
    return grid_.nth(spark, grid_.count() * 3 // 4)


@register(f"WITH {_CONDITIONAL} SELECT row_number() OVER (ORDER BY region) - 1 AS batch_nr, region, min(idx) AS start, max(idx) + 1 AS end FROM whole GROUP BY region")
def conditional_batches(spark: SparkSession, d: str) -> DataFrame:
    return _conditional(spark, d).batches()


@register(f"""WITH {_CONDITIONAL}, {_v('p', 'orders', 'o_orderpriority')}, b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY region) AS k, dense_rank() OVER (ORDER BY region) - 1 AS batch_nr FROM whole)
    SELECT batch_nr, i + k * p.pos AS nr, region, nation, supplier, segment, p.value AS priority FROM b, p""")
def conditional_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Batches by the key of the conditional values; each has all values of another parameter."""
    return _conditional(spark, d).batch_rows({"priority": _values(spark, d, "orders", "o_orderpriority")})


@register(f"""WITH {_CONDITIONAL}, {_v('p', 'orders', 'o_orderpriority')}, {_v('ty', 'part', 'p_brand')}, k AS (SELECT count(*) AS n FROM whole)
    SELECT * FROM (SELECT idx + k.n * (p.pos + (SELECT count(*) FROM p) * ty.pos) AS idx, region, nation, supplier, segment, p.value AS priority, ty.value AS brand FROM whole, p, ty, k) WHERE idx BETWEEN (SELECT n FROM k) AND (SELECT n * 2 FROM k)""")
def conditional_product(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the product of the conditional grid with two other parameters."""
    grid_ = _conditional(spark, d)
    n = grid_.count()
    others = {"priority": _values(spark, d, "orders", "o_orderpriority"), "brand": _values(spark, d, "part", "p_brand")}
    return conditional.product_slice(spark, grid_, others, n, 2 * n + 1)


_ENCODED = "replace(replace(replace({c}, '%', '%25'), ' ', '+'), '#', '%23')"


@register(f"WITH {REQUESTS} SELECT query, 'priority=' || {_ENCODED.format(c='prio')} || '&status=' || stat AS query_string FROM requests")
def query_string(spark: SparkSession, d: str) -> DataFrame:
    return t.requests(spark, d).select("query", text.query_string(F.col("params")).alias("query_string"))


@register(f"WITH {REQUESTS} SELECT query, '/search?nation=' || {_ENCODED.format(c='nation')} || '&priority=' || {_ENCODED.format(c='prio')} || '&rows=10.00&status=' || stat AS url, 'find ' || tag || ' in ' || nation AS body, 'from=' || nation || ',home;via=' || lower(tag) AS headers FROM requests")
def build_requests(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.create_map(F.lit("rows"), F.array(text.number_text(F.lit(10.0))), F.lit("nation"), F.array("nation"))
    body = F.lit("find #seg in #nat")
    replacements = F.create_map(F.lit("#seg"), F.col("tag"), F.lit("#nat"), F.col("nation"))
    own, both = F.create_map(F.lit("from"), F.array(F.lit("#nat"), F.lit("home"))), F.create_map(F.lit("from"), F.array(F.lit("home")), F.lit("via"), F.array(F.lower("tag")))
    rows = requests.build_requests(t.requests(spark, d), F.lit("search"), F.col("params"), fixed=fixed, body=body, body_replacements=replacements, fixed_headers=own, headers=both, header_replacements=replacements)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("request_headers")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return rows.select("query", "url", F.col("request_body").alias("body"), headers.alias("headers"))


@register("WITH x AS (SELECT user_id, event_type, list(event_id::VARCHAR ORDER BY event_id) AS v FROM events WHERE value > 15 GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || array_to_string(v, '|'), '&' ORDER BY event_type) AS params FROM x GROUP BY 1")
def param_list_to_map(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").filter("value > 15").select("user_id", F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("pos"))
    maps = requests.param_list_to_map(rows, ["user_id"])
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), "&").alias("params"))


@register(f"WITH {METRIC_ROWS}, x AS (SELECT tag, metric, value FROM m UNION ALL SELECT '(ALL)', metric, value FROM m) SELECT tag, metric, round(coalesce(avg(value), 0), 6) AS value, count(value) AS success_count, count(*) - count(value) AS fail_count FROM x GROUP BY ALL")
def stream_aggregate_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric rows written as files twice over, as a sender that repeats itself delivers them, streamed in and kept as
    running aggregates; each row counts once. A row of a file has all metrics of a request under one sequence number."""
    from relevanta.operators.metrics import by_metric
    from relevanta.sources.work import work_path
    from relevanta.streaming import aggregates

    base = work_path(spark, "stream")
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("query") % 3600)
    rows = t.metric_records(spark, d).select(F.array("tag", F.lit("(ALL)")).alias("tags"), "records", F.col("tag").alias("sender"), F.col("query").cast("string").alias("seq"), sent.alias("sent_at"))
    rows.write.parquet(f"{base}/rows")
    spark.read.parquet(f"{base}/rows").write.mode("append").parquet(f"{base}/rows")
    files = aggregates.files_per_trigger(len(spark.read.schema(rows.schema).parquet(f"{base}/rows").inputFiles()))
    keys = ["tag", "metric"]
    stream = aggregates.without_replays(aggregates.read_metric_stream(spark, f"{base}/rows", rows.schema, files))
    query = aggregates.write_partials(aggregates.by_tag(by_metric(stream)), f"{base}/out", f"{base}/state", keys, 3)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return aggregates.merged(spark, f"{base}/out", keys).select("tag", "metric", F.round("value", 6).alias("value"), "success_count", "fail_count")
