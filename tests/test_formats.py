"""Formats of nested records, requests of six dimensions, metrics that fail alone."""

import pytest
from pyspark.sql import functions as F

from relevanta.functions import ranking
from relevanta.operators import metrics, requests
from relevanta.operators.formats import Anything, Each, Either, Entries, Field, Leaf, Record, between, choice, invalid_parts, regex, typed


def broken(spark, format_, *documents):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, d string")
    return [r[0] for r in rows.orderBy("i").select(invalid_parts(F.col("d"), format_)).collect()]


def test_leaves(spark):
    cases = {
        "int": (typed("int"), ["1", "-7"], ["1.5", '"1"', "true", "null", "[]", "{}"]),
        "number": (typed("number"), ["1", "1.5", "-2e10"], ['"1"', "null"]),
        "string": (typed("string"), ['""', '"x"'], ["1", "null", '["x"]']),
        "boolean": (typed("boolean"), ["true", "false"], ["1", '"true"']),
        "regex": (regex("a+|b"), ['"aa"', '"b"'], ['"ab"', '"xaa"', "1"]),
        "choice": (choice(["x", "y"]), ['"x"'], ['"z"', "1"]),
        "numbers": (choice([1, 2]), ["1"], ["3", "1.5", '"1"']),
        "between": (between(1, 5), ["1", "5", "2.5"], ["0.9", "6", '"3"']),
        "low": (between(low=2, kind="int"), ["2", "999"], ["1", "2.5"]),
        "own": (Leaf("string", "short", lambda x: F.length(x) > 2), ['"abc"'], ['"ab"']),
        "anything": (Anything(), ["1", "null", "{}"], []),
        "each": (Each(typed("int")), ["[]", "[1,2]"], ["[1,null]", "1", '["1"]', "{}"]),
        "nested": (Each(Each(choice(["a"]))), ['[["a"],[]]'], ['["a"]', '[["b"]]']),
        "map": (Entries(lambda k: k.rlike("^k"), Each(between(0, 1))), ["{}", '{"k1":[0.5],"k":[]}'], ['{"x":[0]}', '{"k":[2]}', '{"k":1}', "[]"]),
        "either": (Either([typed("int"), regex("n.*"), Each(typed("int"))]), ["1", '"no"', "[3]"], ['"yes"', "1.5", "[null]"]),
    }
    for name, (format_, good, bad) in cases.items():
        assert broken(spark, format_, *good) == [[]] * len(good), name
        assert all(broken(spark, format_, *bad) if bad else []), name


def test_records_nest_and_depend_on_fields(spark):
    inner = Record([Field("n", typed("int")), Field("t", typed("string"), required=False)])
    whole = Record(
        [Field("id", typed("int")), Field("parts", Each(inner)), Field("x_[0-9]+", regex("v.*"), required=False, pattern=True)],
        {"type": {"A": [Field("a", between(0, 1)), Field("deep", Record([Field("inner", inner)]))], "B": []}},
    )
    good = '{"id":1,"parts":[{"n":1},{"n":2,"t":"x","more":[]}],"type":"B","x_12":"value","other":null}'
    nested = '{"id":1,"parts":[],"type":"A","a":0.5,"deep":{"inner":{"n":3}}}'
    assert broken(spark, whole, good, nested) == [[], []]
    found = broken(spark, whole, '{"id":"1","parts":[{"n":null},{"t":1},3],"type":"C","x_1":"w"}', '{"type":"A","a":7,"deep":{"inner":{}}}', "[]", "not json", None, '{"id":1,"parts":[]}')
    assert found[0] == ["id: not int", "parts[].n: missing", "parts[].n: not int", "parts[].t: not string", "parts[]: not a record", "type: unknown condition", "x_[0-9]+: no match"]
    assert found[1] == ["a: out of range", "deep.inner.n: missing", "id: missing", "parts: missing"]
    assert found[2:] == [["record: not a record"], ["not JSON"], ["not JSON"], ["type: unknown condition"]]


def table(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value string")


def test_permutations_of_six_dimensions(spark):
    dims = {
        "bodies": {"": table(spark, "B1 $x", "B2 $x")},
        "params": {"p": table(spark, "a", "b"), "q": table(spark)},
        "headers": {"h": table(spark, "1", "2 $v")},
        "body_replacements": {"$x": table(spark, "X", "Y")},
        "url_replacements": {"a": table(spark, "A A")},
        "header_replacements": {"$v": table(spark, "V")},
    }
    rows = requests.request_permutation(spark, "s", dims).orderBy("idx").collect()
    want = [(f"/s?p={p}", {"h": [h]}, f"{b} {x}") for b in ("B1", "B2") for x in "XY" for h in ("1", "2 V") for p in ("A+A", "b")]
    assert [(r["url"], r["request_headers"], r["request_body"]) for r in rows] == want
    assert [r["idx"] for r in requests.request_permutation(spark, "s", dims, 3, 6).orderBy("idx").collect()] == [3, 4, 5]
    only = requests.request_permutation(spark, "s", {"params": {"q": table(spark)}}).collect()
    assert [(r["idx"], r["url"], r["request_headers"], r["request_body"]) for r in only] == [(0, "/s", {}, "")]
    with pytest.raises(ValueError):
        requests.request_permutation(spark, "s", {"cookies": {}})


def test_headers_join_or_replace(spark):
    row = spark.range(1)
    fixed = F.create_map(F.lit("a"), F.array(F.lit("1")), F.lit("b"), F.array(F.lit("$x")))
    own = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("c"), F.array(F.lit("3")))
    build = lambda **x: requests.build_requests(row, F.lit("s"), F.create_map().cast("map<string,array<string>>"), **x).first()["request_headers"]
    assert build(fixed_headers=fixed, headers=own) == {"a": ["1", "2"], "b": ["$x"], "c": ["3"]}
    assert build(fixed_headers=fixed, headers=own, replace_headers=True) == {"a": ["1", "2"], "c": ["3"]}
    assert build(fixed_headers=fixed, header_replacements=F.create_map(F.lit("$x"), F.lit("y"), F.lit("a"), F.lit("z"))) == {"a": ["1"], "b": ["y"]}
    assert build() == {}


def test_a_metric_fails_alone(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, []), (2, 1.0, 0.0, []), (3, None, 1.0, []), (4, 1.0, 1.0, ["NO_RESULTS"])], "q int, a double, b double, failed array<string>")

    def ratio(a, b):
        return a / b if b != 2.0 else None

    own = {"ratio": ranking.python_metric(ratio, F.col("a"), F.col("b")), "a": ranking.ok(F.col("a")), "c": ranking.ok(F.lit(0))}
    out = {(r["q"], r["metric"]): (r["value"], r["reasons"]) for r in metrics.calculate_metrics(rows, own, ["q"], needs={"ratio": ["b"], "a": ["a"], "c": ["b", "c"]}).collect()}
    assert out[1, "ratio"] == (None, ["NO_RESULTS"]) and out[2, "ratio"] == (None, ["ZeroDivisionError"]) and out[3, "ratio"] == (None, ["TypeError"])
    assert out[1, "a"] == (1.0, []) and out[3, "a"] == (None, ["MISSING_DATA_KEY-a"])
    assert all(out[q, "c"] == (None, ["MISSING_DATA_KEY-c"]) for q in (1, 2, 3))
    assert all(out[4, m] == (None, ["NO_RESULTS"]) for m in own)


def test_faults_are_bits(spark):
    """Elements add up bits, not arrays of texts; a tree of more texts than a long has bits tells them all, in order."""
    many = Record([Field(f"f{i}", between(0, i)) for i in range(100)])
    texts = invalid_parts(F.col("d"), many)
    plan = spark.createDataFrame([("{}",)], "d string").select(invalid_parts(F.col("d"), Each(Each(choice(["a"])))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "array_distinct" not in plan
    document = "{" + ",".join(f'"f{i}":{i if i % 2 else i + 1}' for i in range(1, 100)) + "}"
    rows = spark.createDataFrame([(document,), ("{}",)], "d string").select(texts).collect()
    assert rows[0][0] == sorted(["f0: missing", *(f"f{i}: out of range" for i in range(2, 100, 2))])
    assert rows[1][0] == sorted(f"f{i}: missing" for i in range(100))


def test_leaves_read_from_json_keep_their_kind(spark):
    """A leaf's JSON text is no other kind's: quoted numbers, decimals that are whole, doubles that aren't finite, escapes."""
    assert broken(spark, between(1, 5, "int"), "1.0", '"1"', "12345678901234567890") == [[": out of range"]] * 3
    assert broken(spark, between(low=1), "1e400", "1.0", "12345678901234567890") == [[]] * 3
    assert broken(spark, between(low=1), '"Infinity"', '"1"', "-1e400") == [[": out of range"]] * 3
    assert broken(spark, choice(['x"x', "é", "Infinity"]), r'"x\"x"', r'"é"', '"Infinity"') == [[]] * 3
    assert broken(spark, choice(["Infinity", "1"]), "1e400", "1") == [[": not a choice"]] * 2
    names = Record([Field("n", typed("int")), Field("N", typed("string"))])
    assert broken(spark, names, '{"n":1,"N":"x"}', '{"N":1,"n":"x"}') == [[], ["N: not string", "n: not int"]]
