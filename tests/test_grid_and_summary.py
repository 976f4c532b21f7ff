import pytest
from pyspark.sql import functions as F

from relevanta.operators import checks, extract, grid, requests, summary


def test_grid_order_and_slices(spark):
    params = {"a": ["x", "y"], "b": ["1", "2", "3"], "c": [True, False]}
    rows = grid.param_grid(spark, params).orderBy("idx").collect()
    assert len(rows) == grid.grid_size([2, 3, 2]) == 12 and [(r.a, r.b, r.c) for r in rows[:3]] == [("x", "1", True), ("y", "1", True), ("x", "2", True)]
    assert grid.param_grid(spark, params, 5, 9).orderBy("idx").collect() == rows[5:9] and grid.grid_nth(spark, params, 11).collect() == rows[11:]
    assert grid.param_grid(spark, params, 12, 20).collect() == []
    back = grid.param_grid(spark, params).select("idx", grid.index_of(grid.digits(F.col("idx"), [2, 3, 2]), [2, 3, 2]).alias("i"))
    assert all(r.idx == r.i for r in back.collect())
    counts = grid.batch_at_most(grid.param_grid(spark, params), 5, 12).groupBy("batch_nr").count().collect()
    assert sorted((r.batch_nr, r["count"]) for r in counts) == [(0, 3), (1, 3), (2, 3), (3, 3)]


def values(spark, *v):
    return spark.createDataFrame(list(enumerate(v)), "pos long, value string")


def test_conditional_values_and_batches(spark):
    keys = values(spark, "key1", "key2", "key3").select(F.col("value").alias("q"))
    mapping = spark.createDataFrame([("key1", "m1"), ("key1", "m2"), ("key2", "m3"), ("key2", "m4")], "key string, value string")
    pairs = grid.mapped_values(keys, "q", [("mapped", mapping, "q")])
    assert pairs.count() == 4 and grid.prune_unmapped_keys(keys, "q", [mapping]).count() == 2
    numbered = grid.batch_by_param(pairs, "q", values(spark, "key1", "key2", "key3"))
    assert {(r.q, r.batch_nr) for r in numbered.collect()} == {("key1", 0), ("key2", 1)}
    with pytest.raises(ValueError, match="comes after"):
        grid.mapped_values(keys, "q", [("x", mapping, "later")])
    assert grid.range_values(spark, 0.0, 1.0, 0.25).count() == 5
    assert [r.value for r in grid.distinct_values(values(spark, "b", "a", "b")).orderBy("pos").collect()] == ["b", "a"]
    assert [(r.pos, r.value) for r in grid.ordered_union([values(spark, "a", "b"), values(spark, "c")]).orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_requests(spark):
    rows = spark.range(1).select(F.create_map(F.lit("q"), F.array(F.lit("a b"))).alias("p"))
    fixed = F.create_map(F.lit("q"), F.array(F.lit("x")), F.lit("n"), F.array(F.lit("1")))
    both = requests.build_requests(rows, F.lit("/s"), F.col("p"), fixed=fixed, body=F.lit("$q1$q"), body_replacements=F.create_map(F.lit("$q"), F.lit("Z"))).first()
    assert both.url == "/s?n=1&q=x&q=a+b" and both.request_body == "Z1Z"
    assert requests.build_requests(rows, F.lit("/s"), F.col("p"), fixed=fixed, replace=True).first().url == "/s?n=1&q=a+b"


SETTINGS = [({"p1": ["v1"], "p2": ["0.4"]}, 0.6), ({"p1": ["v2"], "p2": ["0.3"]}, 0.6), ({"p1": ["v3"], "p2": ["0.0"]}, 0.6), ({"p1": ["v4"]}, 0.3), ({"p1": ["v5"]}, 0.4)]


def settings(spark):
    from relevanta.functions.text import params_key

    rows = spark.createDataFrame([("t", "m", p, v, 1) for p, v in SETTINGS], "tag string, metric string, params map<string,array<string>>, value double, success_count long")
    return rows.withColumn("params_key", params_key(F.col("params")))


def test_summary(spark):
    got = summary.run_summary(settings(spark)).first()
    assert (got.best, got.best_value, got.worst, got.worst_value) == ("p1=v3&p2=0.0", 0.6, "p1=v4", 0.3)
    assert got.median_shift["p1"] == pytest.approx(0.3) and got.median_shift["p2"] == pytest.approx(0.0)
    assert got.single_shift["p1"] == pytest.approx(0.1) and got.single_shift["p2"] == pytest.approx(0.0)
    matrix = {r.measure: r for r in summary.summary_effect_matrix(summary.run_summary(settings(spark)), ["p1"]).collect()}
    assert matrix["median_shift"].p1 == "0.3000"
    buckets = [r.bucket for r in summary.group_similar_values(settings(spark), 0.15).orderBy(F.desc("value"), "params_key").collect()]
    assert buckets == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError, match="no rows"):
        summary.sort_by_metric(settings(spark), "other", 3)
    assert [r.value for r in summary.sort_by_metric(settings(spark), "m", 2, worst=True).collect()] == [0.3, 0.4]
    change = summary.improving_losing(settings(spark), "p1=v5")
    assert {r.params_key: round(r.change, 6) for r in change.collect()}["p1=v4"] == -0.1


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, [1, 2], {"k": "v"}), (2, "zz", None, [1, -2], {}), (3, None, 50.0, None, None)], "id int, kind string, x double, xs array<int>, m map<string,string>")
    rules = [checks.rule_required("kind"), checks.rule_regex("kind", "[a-z]"), checks.rule_between("x", 0, 10), checks.rule_each("xs", lambda v: v > 0), checks.rule_map("m", lambda k: k == "k", lambda v: v.isNotNull()), *checks.rule_conditional("kind", {"a": [checks.rule_choice("id", [1])]})]
    got = {r.id: r.invalid for r in checks.validate_records(rows, rules).collect()}
    assert got == {1: [], 2: ["kind: no match", "xs: bad element", "kind: unknown condition"], 3: ["kind: missing", "x: out of range", "kind: unknown condition"]}
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, None)], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0000001, "x"), (2, 2.5, "z"), (4, 1.0, "q")], "k int, v double, s string")
    assert {r.k: r.faults for r in checks.table_differences(a, b, ["k"]).collect()} == {2: ["v", "s"], 3: ["only left"], 4: ["only right"]}


def test_extraction(spark):
    document = '{"response": {"numFound": 2, "docs": [{"id": "11", "product_id": "12", "s": {"product_id": "in"}}, {"product_id": "p2"}]}, "x": 1.5}'
    rows = spark.createDataFrame([(1, document), (2, '{"response": {"docs": []}}'), (3, "no json"), (4, None)], "id int, body string")
    fields = {"n": (r"\ response \ numFound", "INT"), "ids": (r"\ response \ docs \\ product_id", "STRING"), "inner": (r"\\ s \ product_id", "STRING"), "deep": (r"\\ docs \\ product_id", "STRING"), "x": (r"\ x", "DOUBLE")}
    got = {r.id: r for r in extract.extract_fields(rows, "body", fields).collect()}
    assert (got[1].n, got[1].x, got[1].ids, got[1].inner, got[1].deep) == (2, 1.5, ["12", "in", "p2"], ["in"], ["12", "in", "p2"])
    assert got[2].n is None and got[2].ids == [] and got[3].ids == [] and got[4].n is None and got[4].ids == []
    plain = rows.select("id", extract.extract_records(F.col("body"), ["response", "docs"], "product_id").alias("v")).orderBy("id").collect()
    assert [r.v for r in plain] == [["12", "p2"], [], [], []]
    with pytest.raises(ValueError, match="not a selector"):
        extract.parse_selector("a b")
    assert spark.range(1).select(extract.typed_cast(F.array(F.lit("1"), F.lit("x")), "SEQ[INT]").alias("v")).first().v == [1, None]


def test_keys_with_dots_and_quotes(spark):
    rows = spark.createDataFrame([('{"a.b": 3, "a": {"b": 4, "c d": 5, "it\'s?": 6}, "xs": [{"p.q": "1"}, {"r": 0}, {"p.q": "2"}]}',)], "body string")
    found = rows.select(*(extract.extract_plain(F.col("body"), keys, "INT").alias(f"v{i}") for i, keys in enumerate([["a.b"], ["a", "b"], ["a", "c d"], ["a", "it's?"], ["a", "none"]])), extract.extract_records(F.col("body"), ["xs"], "p.q", "INT").alias("xs")).first()
    assert tuple(found) == (3, 4, 5, 6, None, [1, 2])


def test_direct_fields_stay_in_the_jvm(spark, capsys):
    rows = spark.createDataFrame([(1, '{"r": {"docs": [{"id": "1", "s": {"id": "in"}}, {"id": "2"}]}}')], "n int, body string")
    fields = {"ids": (r"\ r \ docs \\ id", "INT")}
    got = extract.extract_fields(rows, "body", fields, direct=("ids",))
    got.explain("formatted")
    assert "EvalPython" not in capsys.readouterr().out and got.first().ids == [1, 2]
    assert extract.extract_fields(rows, "body", fields).first().ids == [1, None, 2]
    with pytest.raises(ValueError, match="not a field"):
        extract.extract_fields(rows, "body", {"x": (r"\\ r \ id", "INT")}, direct=("x",))


def test_many_settings_fall_into_buckets(spark):
    rows = spark.range(40_000).select(F.lit("t").alias("tag"), F.lit("m").alias("metric"), F.col("id").cast("string").alias("params_key"), (F.col("id") % 20_000 / 20_000.0).alias("value"))
    got = summary.group_similar_values(rows, 0.1).groupBy("bucket").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.min("value").alias("least"), F.max("bucket_value").alias("head")).orderBy("bucket").collect()
    assert sum(r.n for r in got) == 40_000 and [r.bucket for r in got] == list(range(len(got)))
    assert all(r.head == r.most and r.head - r.least <= 0.1 for r in got) and all(a.head - b.head > 0.1 for a, b in zip(got, got[1:], strict=False))


def test_products_and_numbers(spark):
    a, b = values(spark, "x", "y"), values(spark, "1", "2", "3")
    merged = [r.value for r in grid.grid_merge(a, b, lambda u, v: F.concat(u, v)).orderBy("pos").collect()]
    assert merged == ["x1", "y1", "x2", "y2", "x3", "y3"]
    whole = grid.table_grid({"a": a, "b": b, "c": a})
    left = grid.remove_param(whole, {"a": 2, "b": 3, "c": 2}, "b").orderBy("idx").collect()
    assert [tuple(r) for r in left] == [(0, "x", "x"), (1, "y", "x"), (2, "x", "y"), (3, "y", "y")]
    assert [r.mapped for r in grid.grid_map(whole, F.concat("c", "b", "a")).orderBy("idx").limit(3).collect()] == ["x1x", "x1y", "x2x"]
    many = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    assert [(r.k, r.at) for r in grid.numbered(many, ["k"], "at").orderBy("at").collect()] == [(i + 1, i) for i in range(1000)]
