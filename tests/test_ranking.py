"""Ranking metrics, judgements, tags and aggregates on small frames with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from relevanta.functions import ranking as r
from relevanta.functions import text
from relevanta.operators import aggregate as agg
from relevanta.operators import judgements, metrics, tags


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<double>").alias(k) for k, v in values.items()) or [F.lit(0)])
    got = frame.select(column.alias("x")).first()["x"]
    return got if not hasattr(got, "value") else (got.value, got.reasons)


LIST, BEST = [0.8, 0.0, 0.9, 0.5], [0.9, 0.8, 0.5, 0.0]


def test_dcg_and_ndcg(spark):
    dcg, top = 0.8 + 0.9 / math.log(4) + 0.5 / math.log(5), 0.9 + 0.8 / math.log(3) + 0.5 / math.log(4)
    assert one(spark, r.dcg_at_k(F.col("g"), 5), g=LIST)[0] == pytest.approx(dcg)
    assert one(spark, r.ndcg_at_k(F.col("g"), F.col("b"), 5), g=LIST, b=BEST)[0] == pytest.approx(dcg / top)
    assert one(spark, r.dcg_at_k(F.col("g"), 5), g=[]) == (None, ["NO_RESULTS"])
    assert one(spark, r.dcg_at_k(F.col("g"), 5), g=[0.3]) == (0.3, [])
    assert one(spark, r.ndcg_at_k(F.col("g"), F.col("b"), 5), g=[0.3], b=[0.3]) == (1.0, [])
    assert one(spark, r.ndcg_at_k(F.col("g"), F.col("b"), 5), g=[0.0], b=[0.0]) == (None, ["ZERO_DENOMINATOR"])
    assert one(spark, r.ndcg_at_k(F.col("g"), F.col("b"), 5), g=[0.0, 0.0], b=[0.0, 0.0]) == (None, ["ZERO_DENOMINATOR"])


def test_precision_recall_err(spark):
    assert one(spark, r.precision_at_k(F.col("g"), 5, 0.5), g=LIST) == (0.75, [])
    assert one(spark, r.precision_at_k(F.col("g"), 5, 0.6), g=LIST) == (0.5, [])
    assert one(spark, r.precision_at_k(F.col("g"), 5, 0.6), g=[]) == (None, ["NO_JUDGEMENTS"])
    assert one(spark, r.recall_at_k(F.col("g"), F.col("b"), 2, 0.6), g=LIST, b=BEST) == (0.5, [])
    assert one(spark, r.recall_at_k(F.col("g"), F.col("b"), 2, 0.95), g=LIST, b=BEST) == (None, ["ZERO_DENOMINATOR"])
    left, want = 1.0, 0.0
    for rank, g in enumerate(LIST, 1):
        stop = (2 ** (3 * g) - 1) / 8
        want, left = want + left * stop / rank, left * (1 - stop)
    assert one(spark, r.err_at_k(F.col("g"), 4), g=LIST)[0] == pytest.approx(want)


def test_flags_and_values(spark):
    flags, words = F.array(*map(F.lit, [False, True, True])), F.array(*map(F.lit, ["a", "b", "a", "c", "a"]))
    assert one(spark, r.first_match(flags)) == (1.0, []) and one(spark, r.first_match(flags, False)) == (0.0, [])
    assert one(spark, r.first_match(F.array(F.lit(False)))) == (None, ["NO_RESULTS"])
    assert one(spark, r.match_count(flags)) == (2.0, []) and one(spark, r.binary_precision(flags, 2)) == (0.5, [])
    assert one(spark, r.value_counts(words, 2)) == {"a": 3.0, "b": 1.0} and one(spark, r.value_counts(words, 2, True)) == {"a": 1.0, "b": 1.0}
    assert one(spark, r.position_histogram(words, 3)) == {"a": {"0": 1.0, "2": 1.0}, "b": {"1": 1.0}}
    assert one(spark, r.jaccard(words, F.array(F.lit("a"), F.lit("z"))))[0] == pytest.approx(1 / 4)
    assert one(spark, r.jaccard(words, F.lit(None).cast("array<string>"), ("p", "q"))) == (None, ["MISSING_DATA_KEY-q"])


def test_judged_lists(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "z", 1)], "query string, product string, rank int")
    judged = spark.createDataFrame([("q1", "a", 0.2, 1), ("q1", "a", 0.4, 2), ("q1", "c", 0.8, 3), ("q1", "x", 0.9, 4)], "query string, product string, grade double, n int")
    got = {x.query: x for x in judgements.judged_lists(results, judgements.last_grades(judged, "n"), ["query"], constant=None, most_missing=0.1).collect()}
    assert got["q1"].grades == [0.4, None, 0.8] and got["q1"].current == pytest.approx([0.4, 0.6, 0.8])
    assert got["q1"].ideal == pytest.approx([0.9, 0.8, 0.6]) and got["q1"].failed == ["TOO_FEW_JUDGEMENTS"]
    assert got["q2"].failed == ["NO_JUDGEMENTS", "TOO_FEW_JUDGEMENTS"] and got["q2"].current == [0.0]
    rows = metrics.calculate_metrics(judgements.judged_lists(results, judgements.last_grades(judged, "n"), ["query"]), metrics.list_metrics(), ["query"], wanted=["NDCG@2", "unknown"])
    assert {(x.query, x.metric, tuple(x.reasons)) for x in rows.collect()} == {("q1", "NDCG@2", ()), ("q2", "NDCG@2", ("NO_JUDGEMENTS",))}


def test_the_preset_counts_judged_results(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "z", 1)], "query string, product string, rank int")
    judged = spark.createDataFrame([("q1", "a", 0.4), ("q1", "c", 0.8)], "query string, product string, grade double")
    lists = judgements.judged_lists(results, judged, ["query"])
    rows = metrics.calculate_metrics(lists, metrics.list_metrics(), ["query"], always=metrics.judged_metrics())
    got = {(x.query, x.metric): (x.value, list(x.reasons)) for x in rows.collect()}
    assert len(got) == 2 * 14
    assert [got["q1", f"J@{k}"] for k in (2, 4, 8, 12, 24)] == [(1.0, []), *[(2.0, [])] * 4]
    assert [got["q2", f"J@{k}"] for k in (2, 4, 8, 12, 24)] == [(0.0, [])] * 5  # a list without judgements is counted, not failed
    assert got["q2", "NDCG@2"] == (None, ["NO_JUDGEMENTS"])


def test_default_query_metrics_have_the_whole_preset(spark):
    from relevanta.plans.ranking_queries import QUERIES

    got = {x.metric: x for x in QUERIES["default_query_metrics"](spark, "/root/testdata/sf0.001").collect()}
    assert {f"J@{k}" for k in (2, 4, 8, 12, 24)} < set(got) and len(got) == 14
    assert got["J@2"].fail_count == 0 and got["J@2"].success_count == got["NDCG@2"].success_count + got["NDCG@2"].fail_count


def rows(spark):
    data = [("t1", "p=1", "m", 1.0, []), ("t1", "p=1", "m", 0.0, []), ("t1", "p=1", "m", None, ["A", "B"]), ("t2", "p=1", "m", 0.5, []), ("t2", "p=2", "m", None, ["A"])]
    return spark.createDataFrame(data, "tag string, params_key string, metric string, value double, reasons array<string>")


def test_aggregates(spark):
    whole = {(x.tag, x.params_key): x for x in agg.aggregate_metrics(rows(spark)).collect()}
    assert (whole["t1", "p=1"].value, whole["t1", "p=1"].success_count, whole["t1", "p=1"].fail_count) == (0.5, 2, 1)
    assert (whole["t2", "p=2"].value, whole["t2", "p=2"].success_count, whole["t2", "p=2"].fail_count) == (0.0, 0, 1)
    by_metric = agg.aggregate_metrics(rows(spark), ["metric"]).first()
    assert agg.merge_aggregates(agg.aggregate_metrics(rows(spark)), ["metric"]).first().value == pytest.approx(by_metric.value)
    assert agg.aggregate_salted(rows(spark), ["metric"], 4).first() == by_metric
    assert {(x.reason, x.n) for x in agg.agg_fail_reasons(rows(spark), ["metric"]).collect()} == {("A", 2), ("B", 1)}
    weights = spark.createDataFrame([("t1", 3.0)], "key string, weight double")
    total = agg.aggregate_all_weighted(agg.aggregate_metrics(rows(spark)), F.lit(True), weights, F.col("tag")).filter("params_key = 'p=1'").first()
    assert (total.tag, total.weighted_success_count, total.success_count, total.fail_count) == ("(ALL)", 7.0, 3, 1) and total.value == pytest.approx((0.5 * 6 + 0.5) / 7)
    groups = spark.createDataFrame([("g", "t1"), ("g", "t2"), ("h", "t2"), ("h", "t2")], "group string, member string")
    got = {(x.group, x.params_key): x.success_count for x in agg.aggregate_groups(agg.aggregate_metrics(rows(spark)), groups, F.col("tag")).collect()}
    assert got == {("g", "p=1"): 3, ("g", "p=2"): 0, ("h", "p=1"): 1, ("h", "p=2"): 0}
    prefix = spark.createDataFrame([("all", "t"), ("all", "t1")], "group string, member string")
    assert {x.success_count for x in agg.aggregate_groups(agg.aggregate_metrics(rows(spark)), prefix, F.col("tag"), True).collect()} == {3, 0}
    assert agg.aggregate_metrics(rows(spark).limit(0)).collect() == []


def test_maps(spark):
    frame = spark.createDataFrame([(1.0, {"a": 1.0, "b": 2.0}), (3.0, {"a": 3.0})], "w double, m map<string,double>").withColumn("k", F.lit(1))
    assert {x.key: x.value for x in agg.agg_map_sum(frame, ["k"], "m").collect()} == {"a": 4.0, "b": 2.0}
    assert {x.key: x.value for x in agg.agg_map_sum(frame, ["k"], "m", F.col("w")).collect()} == {"a": 10.0, "b": 2.0}
    assert {x.key: x.value for x in agg.agg_map_avg(frame, ["k"], "m", F.col("w")).collect()} == {"a": 2.5, "b": 2.0}
    assert agg.to_map(agg.agg_map_sum(frame, ["k"], "m"), ["k"]).first().map_value == {"a": 4.0, "b": 2.0}
    ones = spark.range(101).select(F.lit(1).alias("k"), F.create_map(F.lit("x"), F.create_map(F.lit("0"), F.lit(1.0))).alias("m"))
    assert agg.agg_nested_map_sum(ones, ["k"], "m").first().value == 101.0


def test_tags_and_text(spark):
    params = F.create_map(F.lit("q"), F.array(F.lit("b c"), F.lit("a")), F.lit("k"), F.array(F.lit("1")))
    assert one(spark, text.params_key(params)) == "k=1&q=a&q=b c" and one(spark, text.query_string(params)) == "k=1&q=b+c&q=a"
    assert one(spark, text.url(F.lit("s"), params)) == "/s?k=1&q=b+c&q=a"
    assert one(spark, tags.tag_by_param(params, "q")) == "(q=a&b c)" and one(spark, tags.tag_by_param(params, "none")) is None
    old = F.array(F.lit("(a=1)"))
    assert one(spark, tags.tag_extend(old, F.lit("(0=x)"), True)) == ["(0=x)-(a=1)"] and one(spark, tags.tag_extend(old, F.lit("(b=2)"), False)) == ["(a=1)", "(b=2)"]
    assert one(spark, tags.tag_extend(old, F.lit(None).cast("string"), True)) == ["(a=1)"]
    assert one(spark, text.param_in_tag(F.lit("(q=blue, x)-1"), "q")) == "blue, x" and one(spark, text.param_in_tag(F.lit("x"), "q", "none")) == "none"
    assert one(spark, text.field_values(F.lit('{"n": 1, "m": {"n":22}}'), "n")) == ["1", "22"]
