import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from relevanta.operators import aggregate, fold, summary
from relevanta.operators.fold import Spans


def covered(intervals):
    days = sorted({x for low, high in intervals if low is not None for x in range(low, high + 1)})
    starts = [d for i, d in enumerate(days) if i == 0 or days[i - 1] != d - 1]
    gaps = [b - a - 1 for a, b in zip(days, days[1:], strict=False)]
    return len(starts), len(days), max(gaps, default=0)


def test_user_aggregate_with_a_hot_key(spark):
    rng, rows = random.Random(1), []
    for i in range(3000):
        low = rng.randrange(5000)
        rows.append(("hot" if i % 3 else f"k{i % 50}", None if i % 100 == 7 else low, low + rng.randrange(-2, 6)))
    rows += [(None, 1, 2), (None, 2, 9), ("empty", None, None)]
    groups = defaultdict(list)
    for k, low, high in rows:
        groups[k].append((low, high) if low is not None and high >= low else (None, None))
    frame = spark.createDataFrame(rows, "k string, low long, high long").repartition(6)
    for most in (2, 50_000):  # a task that may hold two keys sends several states of one
        out = fold.user_aggregate(frame, ["k"], ["low", "high"], Spans.start, Spans.step, Spans.merge, "spans long, days long, gap long", Spans.finish, fan=3, most_keys=most)
        assert {r["k"]: (r["spans"], r["days"], r["gap"]) for r in out.collect()} == {k: covered(v) for k, v in groups.items()}
    assert fold.user_aggregate(frame.limit(0), ["k"], ["low", "high"], Spans.start, Spans.step, Spans.merge, "spans long, days long, gap long", Spans.finish).count() == 0


def test_states_of_a_hot_key_meet_in_lots(spark):
    rows = spark.range(0, 2000, 1, 8).select(F.lit("one").alias("k"), F.col("id").alias("low"), F.col("id").alias("high"))
    out = fold.user_aggregate(rows, ["k"], ["low", "high"], Spans.start, Spans.step, Spans.merge, "spans long, days long, gap long", Spans.finish)
    assert out.first()[1:] == (1, 2000, 0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


METRICS = "tag string, params_key string, metric string, value double, reasons array<string>"


def test_reasons_in_one_pass(spark):
    rows = [("t", "p", "m", 1.0, []), ("t", "p", "m", 0.5, None), ("t", "p", "m", None, ["A", "B"]), ("t", "p", "m", None, ["A"]), ("u", "p", "m", None, ["B", "B"])]
    frame = spark.createDataFrame([r if r[4] is not None else (*r[:4], []) for r in rows], METRICS)
    out = {r["tag"]: r for r in aggregate.aggregate_metrics(frame, reasons=True, weight=F.lit(2.0)).collect()}
    assert (out["t"]["value"], out["t"]["success_count"], out["t"]["weighted_success_count"], out["t"]["fail_count"], out["t"]["weighted_fail_count"]) == (0.75, 2, 4.0, 2, 2.0)
    assert out["t"]["fail_reasons"] == {"A": 2, "B": 1}
    assert (out["u"]["value"], out["u"]["success_count"], out["u"]["fail_count"], out["u"]["fail_reasons"]) == (0.0, 0, 1, {"B": 2})
    merged = aggregate.merge_aggregates(aggregate.aggregate_metrics(frame, reasons=True), ["metric"]).first()
    assert (merged["success_count"], merged["fail_count"], merged["fail_reasons"]) == (2, 3, {"A": 2, "B": 3})
    plan = aggregate.aggregate_metrics(frame, reasons=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1


def test_exact_medians(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.random(), 0.5, -3.0, 1e300])) for _ in range(1501)] + [(f"k{i % 9}", float(rng.randrange(5))) for i in range(200)]
    rows += [(None, 2.0), (None, 4.0), ("none", None), ("one", 7.0)]
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    out = summary.exact_medians(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v")
    assert {r["k"]: r["median"] for r in out.collect()} == {k: statistics.median(v) for k, v in groups.items()}


def test_ends_of_settings_are_limited_before_the_shuffle(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", "m", rng.choice("ab"), float(rng.randrange(30))) for i in range(400)]
    out = summary.top_bottom_per_setting(spark.createDataFrame(rows, "tag string, metric string, params_key string, change double").repartition(4), 3, 2)
    for kind, n, sign in (("best", 3, -1), ("worst", 2, 1)):
        for p in "ab":
            ordered = sorted((r for r in rows if r[2] == p), key=lambda r: (sign * r[3], r[0]))[:n]
            assert [tuple(r)[:4] for r in out.filter((F.col("kind") == kind) & (F.col("params_key") == p)).orderBy("rank").select("tag", "metric", "params_key", "change").collect()] == ordered
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4


def test_changes_against_the_current_setting(spark):
    rows = [("q1", "now", 0.5), ("q1", "x", 0.75), ("q1", "y", 0.25), ("q2", "x", 1.0), ("q3", "now", 1.0)]
    frame = spark.createDataFrame([(q, "m", p, v) for q, p, v in rows], "tag string, metric string, params_key string, value double")
    assert {(r["tag"], r["params_key"], r["change"]) for r in summary.improving_losing(frame, "now").collect()} == {("q1", "x", 0.25), ("q1", "y", -0.25)}


def test_queries_own_aggregates_are_not_grouped(spark):
    from relevanta.plans.ranking_queries import QUERIES

    plan = QUERIES["default_query_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(q=" not in plan  # a group for each query and metric filled a task's memory
