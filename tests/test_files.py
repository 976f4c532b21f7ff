import datetime
import json
import time
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from relevanta.operators.judgements import last_grades
from relevanta.sources import files, results
from relevanta.streaming import aggregates


@pytest.fixture
def put(tmp_path):
    def write(name: str, text: str) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return f"file://{path}"

    return write


def pairs(df, key="key", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_value_files(spark, put):
    path = put("v.txt", "# note\n a \n\nb\na, c\n")
    assert [r.value for r in files.read_lines(spark, path).orderBy("line_id").collect()] == ["a", "b", "a, c"]
    assert [r.value for r in files.read_split_values(spark, path).orderBy("line_id", "pos").collect()] == ["a", "b", "a", "c"]
    assert {r.value for r in files.read_unique_column(spark, put("w.txt", "1   x\n2   y\n3   x\n4\n"), "   ", 1).collect()} == {"x", "y"}


def test_mapping_files(spark, put):
    path = put("m.csv", "1,k1,a\n2,k1,b\n3,k2,c d\n4\n")
    assert pairs(files.read_mapping_csv(spark, path, key=1, value=2)) == {"k1": "b", "k2": "c d"}
    assert pairs(files.read_mapping_csv(spark, path, key=1, value=2, mode="set")) == {"k1": ["a", "b"], "k2": ["c d"]}
    assert pairs(files.read_mapping_csv(spark, path, key=1, value=2, split=" ")) == {"k1": ["b"], "k2": ["c", "d"]}
    assert pairs(files.read_mapping_csv_header(spark, put("h.csv", "id;section\n1;a\n1;b\n2;c\n"), "id", "section", ";"), value="values") == {"1": ["a", "b"], "2": ["c"]}
    assert pairs(files.read_mapping_csv_meta(spark, put("d.csv", "#delimiter=|\nk|v\n"))) == {"k": "v"}
    path = put("m.json", json.dumps({"a": "1", "b": {"c": 2}}))
    assert pairs(files.read_mapping_json(spark, path)) == {"a": "1", "b": '{"c":2}'}
    assert pairs(files.read_mapping_json(spark, put("n.json", '{"a": ["x", "y"]}'), arrays=True)) == {"a": ["x", "y"]}


def test_folders(spark, put):
    put("q/id1.txt", "one\ntwo\n")
    folder = put("q/id2.txt", "three\n").rsplit("/", 1)[0]
    assert pairs(files.read_key_by_filename(spark, folder), value="values") == {"id1": ["one", "two"], "id2": ["three"]}
    assert {r.value for r in files.read_filename_keys(spark, folder).collect()} == {"id1", "id2"}
    assert {(r.key, r.param, tuple(r["values"])) for r in files.read_param_dirs(spark, {"p": folder}).collect()} == {("id1", "p", ("one", "two")), ("id2", "p", ("three",))}
    assert files.list_results(spark, folder, r"id1\..*").count() == 1
    jobs = spark.createDataFrame([("d1", "j1"), ("d1", "j2"), ("d2", "j3")], "date string, job string")
    got = {r.date: (r.jobs, r.summarised) for r in files.results_overview(jobs, jobs.filter("job = 'j2'")).collect()}
    assert got == {"d1": (["j1", "j2"], ["j2"]), "d2": (["j3"], None)}


def test_judgement_files(spark, put):
    path = put("j.txt", "q\u0001p1\u0001x\u00011\u00010.5\nq\u0001p1\u0001x\u00011\u00010.7\n# c\nshort\u0001line\nq\u0001p2\u0001x\u00011\u0001bad\n")
    rows = files.read_judgements_csv(spark, path, "\u0001", 0, 1, 4)
    assert rows.count() == 2 and [r.grade for r in last_grades(rows, "line_id").collect()] == [0.7]
    lines = put("j.jsonl", '{"query":"a","products":[{"productId":"p","score":"0.1"}]}\n{"query":"a","products":[{"productId":"p","score":0.4},{"productId":"r","score":1}]}\n')
    assert {(r.query, r.product, r.grade) for r in files.read_judgements_jsonl(spark, lines).collect()} == {("a", "p", 0.4), ("a", "r", 1.0)}


def long_rows(spark):
    data = [("t1", {"a": ["1"], "b": ["x", "y"]}, "a=1&b=x&b=y", "m1", "DOUBLE_AVG", 0.5, 2, 2.0, 1, 1.0, {"NO_RESULTS": 1}), ("t1", {"a": ["1"], "b": ["x", "y"]}, "a=1&b=x&b=y", "m2", "DOUBLE_AVG", 0.25, 3, 3.0, 0, 0.0, {}), ("t2", {"a": ["2"], "b": ["z"]}, "a=2&b=z", "m1", "DOUBLE_AVG", 0.75, 1, 1.0, 0, 0.0, {})]
    return spark.createDataFrame(data, "tag string, params map<string,array<string>>, params_key string, metric string, agg_type string, value double, success_count long, weighted_success_count double, fail_count long, weighted_fail_count double, fail_reasons map<string,long>")


COLUMNS = ["params_key", "metric", "value", "success_count", "weighted_success_count", "fail_count", "weighted_fail_count", "fail_reasons"]


def facts(df):
    return sorted(((r.tag, *(r[c] if c != "fail_reasons" else sorted(r[c].items()) for c in COLUMNS)) for r in df.collect()), key=str)


def test_wide_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/csv"
    results.write_results_csv(long_rows(spark), path, ["a", "b"], {"m1": "DOUBLE_AVG", "m2": "DOUBLE_AVG"})
    back = results.read_results_csv(spark, path, tag=F.col("tag"))
    filled = [r for r in facts(back.withColumn("tag", F.lit(""))) if r[4] or r[6]]
    assert filled == facts(long_rows(spark).withColumn("tag", F.lit("")))
    assert pairs(results.read_metric_types(spark, path), "metric", "agg_type") == {"m1": "DOUBLE_AVG", "m2": "DOUBLE_AVG"}


def test_wide_file_without_context(spark, put):
    path = put("(q=x)-1.csv", "# K_METRIC_AGGREGATOR_MAPPING N DOUBLE_AVG\no\tfail-count-N\tfailReasons-N\tsuccess-count-N\tvalue-N\n10\t2\tA:1,B:1\t3\t0.5000\n")
    row = results.read_results_csv(spark, path).first()
    assert (row.tag, row.params_key, row.value, row.fail_count, row.success_count, row.fail_reasons, row.weighted_success_count) == ("(q=x)-1", "o=10", 0.5, 2, 3, {"A": 1, "B": 1}, 0.0)


def test_json_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/json"
    results.write_results_json(long_rows(spark), path)
    assert [r for r in facts(results.read_results_json(spark, path)) if r[4] or r[6]] == facts(long_rows(spark))
    results.write_results_by_tag(long_rows(spark), f"file://{tmp_path}/store")
    assert facts(spark.read.parquet(f"file://{tmp_path}/store")) == facts(long_rows(spark))


def test_stream_equals_batch(spark, tmp_path):
    from relevanta.operators.aggregate import aggregate_metrics

    rows = spark.createDataFrame([([f"t{i % 3}", "(ALL)"], "p", "m", float(i) if i % 5 else None, [] if i % 5 else ["X"]) for i in range(60)], "tags array<string>, params_key string, metric string, value double, reasons array<string>")
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = aggregates.stream_aggregate_metrics(aggregates.read_metric_stream(spark, f"{tmp_path}/in", rows.schema, 2))
    query = aggregates.write_running(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    want = aggregate_metrics(rows.withColumn("tag", F.explode("tags")))
    key = lambda df: sorted((r.tag, round(r.value, 9), r.success_count, r.fail_count) for r in df.collect())
    assert key(aggregates.latest(spark, f"{tmp_path}/out")) == key(want)


METRIC_STREAM = "tags array<string>, params_key string, metric string, value double, reasons array<string>, sender string, seq long, sent_at timestamp"


def stream_rows(spark, n=60):
    rows = [([f"t{i % 3}", "(ALL)"], "p", "m", float(i) if i % 5 else None, [] if i % 5 else ["X"], f"s{i % 2}", i // 2, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, METRIC_STREAM)


def sums(df):
    return sorted((r.tag, round(r.value, 9), r.success_count, r.fail_count) for r in df.collect())


def test_stream_counts_replayed_files_once(spark, tmp_path):
    from relevanta.operators.aggregate import aggregate_metrics

    rows, folder = stream_rows(spark), f"file://{tmp_path}/in"
    rows.repartition(6).write.parquet(folder)
    spark.read.parquet(folder).write.mode("append").parquet(folder)  # every file again
    stream = aggregates.without_replays(aggregates.read_metric_stream(spark, folder, rows.schema, 2))
    query = aggregates.write_partials(aggregates.by_tag(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state", snapshot_every=2)
    query.processAllAvailable()
    states = query.lastProgress["stateOperators"]
    query.stop()
    want = sums(aggregate_metrics(rows.withColumn("tag", F.explode("tags"))))
    assert sums(aggregates.merged(spark, f"file://{tmp_path}/out")) == want
    assert len(states) == 1 and states[0]["numRowsTotal"] == 60
    # what is behind the last snapshot but one is gone
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "changes").glob("batch=*"))
    shots = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "snapshots").glob("batch=*"))
    assert len(shots) == 2 and min(kept) > shots[0] and len(kept) <= 4


def test_a_backlog_is_taken_in_few_triggers_with_state_on_disk(spark, tmp_path):
    from relevanta.operators.aggregate import aggregate_metrics
    from relevanta.plans.grid_queries import QUERIES
    from relevanta.plans.tables import metric_rows

    d, settings = "/root/testdata/sf0.001", {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false", "spark.sql.files.openCostInBytes": "1g"}
    before = {k: spark.conf.get(k, None) for k in settings}
    streams = lambda: set(Path((spark.conf.get("spark.checkpoint.dir", None) or "/nowhere").removeprefix("file://")).glob("stream-*"))
    others = streams()
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = QUERIES["stream_aggregate_metrics"](spark, d).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    (base,) = streams() - others
    assert len(list(base.glob("rows/part-*"))) == 48  # 24 files, each twice
    assert len([p for p in base.glob("state/offsets/*") if p.name.isdigit()]) <= 7  # 12 at four files each
    changes = {p.suffix for p in base.glob("state/state/0/*/*") if p.name[0].isdigit()}
    assert ".changelog" in changes and ".delta" not in changes
    tagged = metric_rows(spark, d).withColumn("tag", F.explode(F.array("tag", F.lit("(ALL)"))))
    want = aggregate_metrics(tagged, ["tag", "metric"]).withColumn("value", F.round("value", 6)).select(*got[0].asDict())
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_state_expires_and_late_rows_are_dropped(spark, tmp_path):
    rows, folder = stream_rows(spark, 20), f"{tmp_path}/in"
    later = rows.withColumns({"sent_at": F.col("sent_at") + F.expr("interval 3 days"), "seq": F.col("seq") + 100})
    for part in (rows, later, later.limit(1).withColumn("seq", F.lit(999).cast("long")), rows):  # the first again, far too late
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times
    stream = aggregates.without_replays(aggregates.read_metric_stream(spark, folder, rows.schema, 1))
    query = aggregates.write_partials(aggregates.by_tag(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    states = query.lastProgress["stateOperators"][0]
    query.stop()
    assert states["numRowsTotal"] == 21  # the numbers of the first day have expired
    out = {r.tag: r for r in aggregates.merged(spark, f"{tmp_path}/out").collect()}
    assert out["(ALL)"].success_count + out["(ALL)"].fail_count == 41


def test_streamed_aggregate_for_update_sinks(spark, tmp_path):
    from relevanta.operators.aggregate import aggregate_metrics

    rows = stream_rows(spark)
    rows.write.parquet(f"{tmp_path}/in")
    stream = aggregates.stream_aggregate_metrics(aggregates.read_metric_stream(spark, f"{tmp_path}/in", rows.schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running_sums").start()
    query.processAllAvailable()
    query.stop()
    assert sums(spark.table("running_sums")) == sums(aggregate_metrics(rows.withColumn("tag", F.explode("tags"))))


def test_values_that_break_lines_and_cells(spark, tmp_path):
    odd = ["#1", "u\tv", "p&q", "a\nb", "c\r\nd", "100%", "%09", "#", "plain, é: 漢", " "]
    names = ["#n", "value-x", "a\tb", "contextInfo", "p&%"]
    nothing = {"tag": "t", "agg_type": "DOUBLE_AVG", "success_count": 1, "fail_count": 3, "weighted_success_count": 1.0, "weighted_fail_count": 3.0, "fail_reasons": {"A,B": 1, "C:D": 2, "#E %": 3}, "context_info": '{"q": "x\ty"}'}
    rows = [{**nothing, "params": {n: [v, odd[(i + 1) % len(odd)]] for n in names}, "metric": m, "value": 0.5 + i} for i, v in enumerate(odd) for m in ("m 1", "#m\t2")]
    schema = "tag string, agg_type string, success_count long, fail_count long, weighted_success_count double, weighted_fail_count double, fail_reasons map<string,long>, context_info string, params map<string,array<string>>, metric string, value double"
    frame = spark.createDataFrame(rows, schema).withColumn("params_key", F.to_json("params"))
    path = f"file://{tmp_path}/csv"
    results.write_results_csv(frame, path, names, {"m 1": "DOUBLE_AVG", "#m\t2": "DOUBLE_AVG"}, settings_per_part=4)
    back = results.read_results_csv(spark, path, tag=F.col("tag")).collect()
    fact = lambda r: (json.dumps(r["params"], sort_keys=True), r["metric"], r["value"], json.dumps(r["fail_reasons"], sort_keys=True), r["context_info"], r["success_count"], r["fail_count"])
    assert sorted(map(fact, back)) == sorted(map(fact, rows))
    assert {(r["metric"], r["agg_type"]) for r in results.read_metric_types(spark, path).collect()} == {("m 1", "DOUBLE_AVG"), ("#m\t2", "DOUBLE_AVG")}


def test_files_without_encoding_are_read_as_they_are(spark, put):
    path = put("x.csv", "o\tfail-count-N\tsuccess-count-N\tvalue-N\n100%25&%09\t0\t1\t0.5\n")
    assert results.read_results_csv(spark, path).first().params == {"o": ["100%25", "%09"]}


def test_one_file_is_read_in_splits(spark, tmp_path):
    body = "".join(f"{i}\t0\t1\t{i}.5\n" for i in range(20_000))
    (tmp_path / "big.csv").write_text("# K_METRIC_AGGREGATOR_MAPPING N DOUBLE_AVG\no\tfail-count-N\tsuccess-count-N\tvalue-N\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert spark.read.text(f"file://{tmp_path}/big.csv").rdd.getNumPartitions() > 10
        rows = results.read_results_csv(spark, f"file://{tmp_path}/big.csv")
        assert rows.agg(F.count("*"), F.sum("value"), F.countDistinct("params_key")).first()[:] == (20_000, sum(i + 0.5 for i in range(20_000)), 20_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def typed_rows(spark):
    """A metric of each kind of value; the second setting lacks three of them."""
    nothing = {"value": None, "map_value": None, "nested_value": None, "seq_value": None, "success_count": 2, "fail_count": 0, "fail_reasons": {}, "context_info": '{"q":"x y"}'}
    kinds = [("n", "DOUBLE_AVG", {"value": 0.25}), ("m", "MAP_UNWEIGHTED_SUM_VALUE", {"map_value": {"a": 1.0, "b": 2.5}}), ("h", "NESTED_MAP_WEIGHTED_SUM_VALUE", {"nested_value": {"a": {"0": 1.0}, "c": {"3": 2.0}}}), ("s", "SEQUENCE_KEEP_FIRST", {"seq_value": ["p", "q\tr"]}), ("v", "MAP_AVG_VALUE", {"map_value": {"a": 0.5}})]
    rows = [{"tag": "t", "params": {"p": ["1"]}, "params_key": "p=1", "metric": m, "agg_type": k, **nothing, **own} for m, k, own in kinds]
    rows.append({**rows[0], "params": {"p": ["2"]}, "params_key": "p=2", "fail_count": 1, "fail_reasons": {"NO_RESULTS": 1}})
    schema = "tag string, params map<string,array<string>>, params_key string, metric string, agg_type string, value double, map_value map<string,double>, nested_value map<string,map<string,double>>, seq_value array<string>, success_count long, fail_count long, fail_reasons map<string,long>, context_info string"
    return spark.createDataFrame(rows, schema), {m: k for m, k, _ in kinds}


def test_documents_of_all_types(spark, tmp_path):
    rows, types = typed_rows(spark)
    want = {(r.params_key, r.metric): (r.value, r.map_value, r.nested_value, r.seq_value, r.success_count, r.fail_count, r.fail_reasons) for r in rows.collect()}
    empty = {"m": (None, {}, None, None), "h": (None, None, {}, None), "s": (None, None, None, []), "v": (None, {}, None, None)}
    results.write_results_csv(rows, f"file://{tmp_path}/csv", ["p"], types, settings_per_part=1)
    results.write_results_json(rows, f"file://{tmp_path}/json", settings_per_part=1)
    back = {"csv": results.read_results_csv(spark, f"file://{tmp_path}/csv", tag=F.col("tag")), "json": results.read_results_json(spark, f"file://{tmp_path}/json")}
    for name, df in back.items():
        found = {(r.params_key, r.metric): r for r in df.collect()}
        for key, r in found.items():
            own = (r.value, r.map_value, r.nested_value, r.seq_value)
            assert r.tag == "t" and json.loads(r.context_info) == {"q": "x y"} and r.params == {"p": [key[0][2:]]}, name
            assert (*own, r.success_count, r.fail_count, r.fail_reasons) == want[key] if key in want else own == empty[key[1]] and r.success_count == 0, (name, key)
        assert set(want) <= set(found)
    assert len(list(tmp_path.glob("csv/tag=t/part=*"))) == 2


def test_aggregate_by_type(spark):
    from relevanta.operators.aggregate import aggregate_metrics, aggregate_typed, merge_aggregates

    schema = "tag string, params_key string, metric string, agg_type string, value double, map_value map<string,double>, nested_value map<string,map<string,double>>, seq_value array<string>, seq long, reasons array<string>, w double"
    rows = [("t", "p", "n", "DOUBLE_AVG", v, None, None, None, i, r, w) for i, (v, r, w) in enumerate([(1.0, [], 1.0), (4.0, [], 2.0), (None, ["A", "B"], 5.0)])]
    rows += [("t", "p", "u", "MAP_UNWEIGHTED_SUM_VALUE", None, {"a": 1.0, "b": 1.0}, None, None, 0, [], 3.0), ("t", "p", "u", "MAP_UNWEIGHTED_SUM_VALUE", None, {"a": 2.0}, None, None, 1, [], 3.0)]
    rows += [("t", "p", "h", "NESTED_MAP_WEIGHTED_SUM_VALUE", None, None, {"a": {"0": 1.0}}, None, i, [], 3.0) for i in range(2)]
    rows += [("t", "p", "s", "SEQUENCE_KEEP_FIRST", None, None, None, x, i, [], 1.0) for i, x in enumerate([[], ["b"], ["a"]])]
    got = {r.metric: r for r in aggregate_typed(spark.createDataFrame(rows, schema), weight=F.col("w")).collect()}
    assert (got["n"].value, got["n"].fail_count, got["n"].fail_reasons, got["n"].weighted_success_count) == (3.0, 1, {"A": 1, "B": 1}, 3.0)
    assert (got["u"].map_value, got["u"].value, got["h"].nested_value, got["s"].seq_value) == ({"a": 3.0, "b": 1.0}, None, {"a": {"0": 6.0}}, ["b"])
    parts = aggregate_metrics(spark.createDataFrame(rows[:3] * 2, schema), reasons=True)
    whole = merge_aggregates(parts.unionByName(parts)).first()
    assert (whole.fail_count, whole.weighted_fail_count, whole.fail_reasons, whole.success_count) == (4, 4.0, {"A": 4, "B": 4}, 8)


def test_stream_with_snapshots(spark, tmp_path):
    from relevanta.operators.aggregate import aggregate_metrics

    keys = ["tag", "metric"]
    rows = spark.createDataFrame([([f"t{i % 7}"], "p", "m", float(i), []) for i in range(90)], "tags array<string>, params_key string, metric string, value double, reasons array<string>")
    rows.repartition(9).write.parquet(f"{tmp_path}/in")
    stream = aggregates.stream_aggregate_metrics(aggregates.read_metric_stream(spark, f"{tmp_path}/in", rows.schema, 1), keys=keys)
    query = aggregates.write_running(stream, f"file://{tmp_path}/out", f"{tmp_path}/state", keys, snapshot_every=2)
    query.processAllAvailable()
    query.stop()
    assert len(list(tmp_path.glob("out/snapshots/batch=*"))) >= 3
    want = aggregate_metrics(rows.withColumn("tag", F.explode("tags")), keys).orderBy(*keys).collect()
    assert aggregates.latest(spark, f"file://{tmp_path}/out", keys).orderBy(*keys).collect() == want
    # batches before the last snapshot are not needed any more
    for old in range(4):
        shutil.rmtree(tmp_path / f"out/changes/batch={old}")
    assert aggregates.latest(spark, f"file://{tmp_path}/out", keys).orderBy(*keys).collect() == want
