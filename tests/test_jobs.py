"""Early stops, named files and joint patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from relevanta.operators import aggregate, gate
from relevanta.operators.patterns import PatternSet, matching, plain_brackets, required_texts
from relevanta.sources import files, named


def slow_rows(spark, tasks, started):
    def run(batches):
        started.add(1)
        for batch in batches:
            time.sleep(0.15)
            yield batch

    return spark.range(0, tasks * 10, 1, tasks).mapInArrow(run, "id long")


def test_a_failing_job_is_cancelled(spark, tmp_path):
    started = spark.sparkContext.accumulator(0)
    out = gate.write_while_good(slow_rows(spark, 200, started), F.lit(True), f"file://{tmp_path}/bad", 0.05, 2000)
    assert out["stopped"] and 100 < out["fails"] <= out["rows"] < 1000
    assert started.value < 100  # of 200 tasks
    assert not (tmp_path / "bad" / "_SUCCESS").exists()


def test_a_good_job_is_written(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 10).withColumn("x", F.when(F.col("id") % 50 > 0, F.col("id")))
    out = gate.write_while_good(rows, F.col("x").isNull(), f"file://{tmp_path}/good", 0.02, 1000)
    assert out == {"stopped": False, "rows": 1000, "fails": 20}
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 1000
    # one more failure than allowed, seen only at the end: nothing stays
    late = gate.write_while_good(rows.coalesce(1), F.col("id") < 21, f"file://{tmp_path}/late", 0.02, 1000)
    assert late["stopped"] and not (tmp_path / "late").exists()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        gate.write_while_good(rows.withColumn("x", F.lit(1) / (F.col("id") - 5)), F.lit(False), f"file://{tmp_path}/error", 0.5, 1000)


def test_named_files(spark, tmp_path):
    rows = [("a b", 2, "second"), ("a b", 1, "first"), ("x/y=é?", 1, "ü"), ("", 1, "nameless"), (None, 1, "lost"), ("none", 1, None)] + [("hot", i, f"line {i}") for i in range(3000)]
    out = named.write_named_files(spark.createDataFrame(rows, "name string, n int, line string").repartition(4), f"file://{tmp_path}/o", "name", "line", ["n"])
    found = {r["name"]: (r["file"], r["lines"]) for r in out.collect()}
    assert found == {"a b": ("a b.txt", 2), "x/y=é?": ("x%2Fy=%C3%A9%3F.txt", 1), "": ("%00.txt", 1), "hot": ("hot.txt", 3000)}
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == sorted(f for f, _ in found.values())
    assert (tmp_path / "o" / "a b.txt").read_text() == "first\nsecond\n"
    assert [r["key"] for r in files.read_key_by_filename(spark, f"file://{tmp_path}/o/hot.txt").collect()] == ["hot"]


def test_a_failed_run_leaves_no_named_file(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select((F.col("id") % 7).cast("string").alias("name"), F.when(F.col("id") < 99, "x").otherwise(F.raise_error(F.lit("broken"))).alias("line"), "id")
    with pytest.raises(Exception, match="broken"):
        named.write_named_files(rows, f"file://{tmp_path}/o", "name", "line", ["id"])
    assert not (tmp_path / "o").exists() or not [p for p in (tmp_path / "o").iterdir() if p.suffix == ".txt"]


def test_required_texts():
    assert required_texts("(q=a.*") == ["(q=a"]
    assert required_texts("ab?cd|x[yz]uvw|\\.a{2}b|a{0,3}") == ["cd", "uvw", ".a", ""]
    assert required_texts("[0-9]+") == [""] and required_texts("[)|x]long\\d") == ["long"]
    assert plain_brackets("(a)+[(]\\(") == "\\(a\\)+[(]\\("


def test_joint_patterns_equal_each_alone(spark):
    rng = random.Random(4)
    tags = ["(" + "".join(rng.choice("abc=1 ") for _ in range(rng.randint(0, 9))) + ")-é" for _ in range(300)] + [""]
    parts = ["a", "b", "(", ")", "c+", "[ab]", ".", "1?", "b{1,2}", "|", "=", ".*", "\\(", "[^a]"]
    patterns = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rules = PatternSet(patterns)
    tests = [re.compile(plain_brackets(p), re.S).match for p in patterns]
    assert [rules.match(t) for t in tags] == [[i for i, test in enumerate(tests) if test(t)] for t in tags]
    out = matching(spark.createDataFrame([(t,) for t in [*tags, None]], "t string"), "t", spark.createDataFrame([(p,) for p in [*patterns, None]], "p string"), "p")
    assert {(r["tag"], r["pattern"]) for r in out.collect()} == {(t, p) for t in tags for p, test in zip(patterns, tests, strict=True) if test(t)}


def test_ten_thousand_patterns_in_passes(spark, monkeypatch):
    from relevanta.operators import patterns as module

    tags = spark.range(20_000).select(F.concat(F.lit("(q="), F.col("id").cast("string"), F.lit(")")).alias("tag"))
    wanted = spark.range(10_000).select(F.concat(F.lit("(q="), F.col("id").cast("string"), F.lit("[0-9]?)")).alias("pattern"))
    began = time.time()
    n = matching(tags, "tag", wanted, "pattern").count()
    assert n == 10_000 + sum(1 for i in range(20_000) if i >= 10 and i // 10 < 10_000) and time.time() - began < 60
    monkeypatch.setattr(module, "PATTERN_CHARS", 100_000)
    assert matching(tags, "tag", wanted, "pattern").count() == n


def test_groups_by_pattern(spark):
    rows = [(t, "p", "m", v, 1, 1.0, 0) for t, v in [("(q=ab)", 0.5), ("(q=b)", 1.0), ("(r=ab)", 0.25)]]
    frame = spark.createDataFrame(rows, "tag string, params_key string, metric string, value double, success_count long, weighted_success_count double, fail_count long")
    groups = spark.createDataFrame([("g", "(q=a"), ("g", "(q=.b"), ("g", "(q"), ("h", ".*b)"), ("i", "q="), (None, "x")], "group string, member string")
    out = {r["group"]: (r["value"], r["success_count"]) for r in aggregate.aggregate_groups(frame, groups, F.col("tag"), pattern=True).collect()}
    assert out == {"g": (0.75, 2), "h": (pytest.approx(1.75 / 3), 3)}
