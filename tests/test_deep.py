import json
import random
from pathlib import Path

from relevanta.operators import extract
from relevanta.operators.deep import extract_deep


def random_value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([1, 2.5, True, None, "x", '{"a":"no record"}', "[1]", ""])
    if kind == 4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    names = rng.sample(["a", "b", "c", "d'", "e f"], rng.randrange(5))
    return {n: random_value(rng, depth - 1) for n in names}


def same(found, want):
    """Equal as texts, or as JSON: numbers may be written in another way."""
    try:
        return found == want or json.loads(found) == json.loads(want)
    except (TypeError, ValueError):
        return False


def test_deep_searches_equal_a_walk(spark):
    rng = random.Random(3)
    documents = [json.dumps(random_value(rng, 5), separators=(",", ":")) for _ in range(150)] + ["not json", None, "{}", "[]"]
    rows = spark.createDataFrame(list(enumerate(documents)), "i int, d string").repartition(3)
    paths = [r"\\ a", r"\\ a \\ b", r"\ a \\ b", r"\\ a \ b", r"\ a \ b", r"\\ b \ c \\ a", r"\\ d'"]
    out = {r["i"]: r for r in extract_deep(rows, ["i"], "d", {f"p{n}": (p, "STRING") for n, p in enumerate(paths)}).collect()}
    for i, d in enumerate(documents):
        for n, path in enumerate(paths):
            try:
                want = [extract._text(v) for v in extract._select(json.loads(d), extract.parse_selector(path))]
            except (TypeError, ValueError):
                want = []
            found = out[i][f"p{n}"]
            assert len(found) == len(want) and all(map(same, found, want)), (d, path, found, want)


def test_types_and_hits_below_the_records(spark):
    text = '{"r":{"docs":[{"id":"1","more":{"id":"2"}},{"id":3.0},{"id":{"x":1}}]}}'
    row = extract_deep(spark.createDataFrame([(1, text)], "k int, d string"), ["k"], "d", {"ids": (r"\ r \ docs \\ id", "INT"), "texts": (r"\\ id", "STRING")}).first()
    assert row["ids"] == [1, 2, None, None] or row["ids"] == [1, 2, 3, None]
    assert row["texts"] == ["1", "2", "3.0", '{"x":1}']


def test_a_search_writes_and_shuffles_nothing(spark):
    """However deep a search goes, its plan is one pass over the rows; rows with one key stay rows of their own."""
    rows = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":7}}}}'), (1, '{"d":8}')], "k int, d string")
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = Path((before or "file:///nowhere").removeprefix("file://"))
    written = set(folder.glob("json-level-*"))
    out = extract_deep(rows, ["k"], "d", {"found": (r"\\ a \\ d", "INT"), "all": (r"\\ d", "INT")})
    assert sorted((r["found"], r["all"]) for r in out.collect()) == [([], [8]), ([7], [7])]
    assert "Exchange" not in out._jdf.queryExecution().toString() and set(folder.glob("json-level-*")) == written
