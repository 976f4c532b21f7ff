import math
import random

import numpy as np
import pytest

import corpus_pipeline
from relevanta.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node string"


def cloud(seed: int, n: int, dim: int = 24) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 5):  # near and exact copies
        x[(i + 1) % n] = x[i] + 0.12 * rng.standard_normal(dim)
        x[(i + 2) % n] = x[i]
    return x


def frame(spark, x: np.ndarray):
    bad = [(9000, None), (9001, []), (9002, [0.0] * x.shape[1]), (9003, [float("nan")] + [1.0] * (x.shape[1] - 1)), (9004, [1.0, None]), (9005, [float("inf"), 1.0]), (None, x[0].tolist()), (9006, [1.0, 2.0]), (9007, [1.0, 2.1])]
    return spark.createDataFrame([(i, e, 0, "x", "y") for i, e in [*((i, r.tolist()) for i, r in enumerate(x)), *bad]], SCHEMA)


def test_near_duplicate_vectors(spark):
    x = cloud(1, 300)
    rows = {r.vec_id: r for r in vectors.near_duplicate_vectors(frame(spark, x)).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[row].min() for row in link])
    found = sum(rows[i].n_links for i in range(len(x)))
    assert found >= 0.98 * (link.sum() - len(x))
    assert all(rows[i].n_links <= link[i].sum() - 1 for i in range(len(x)))
    assert np.mean([rows[i].component_id == label[i] for i in range(len(x))]) >= 0.98
    for i in (9000, 9001, 9002, 9003, 9004, 9005):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)
    assert rows[9007].component_id == 9006 and rows[9007].n_links == 1 and rows[None].kept
    assert vectors.near_duplicate_vectors(frame(spark, x).limit(0)).collect() == []


def test_large_group_of_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)  # several blocks
    rng = np.random.default_rng(3)
    x = (np.ones((400, 24)) + 0.05 * rng.standard_normal((400, 24))).astype(np.float32)
    x[200:300] = x[0]
    rows = {r.vec_id: r for r in vectors.near_duplicate_vectors(frame(spark, x)).collect()}
    assert {rows[i].component_id for i in range(400)} == {0} and {rows[i].n_links for i in range(400)} == {399}


def test_large_bucket_with_few_true_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 128)  # several blocks
    monkeypatch.setattr(vectors, "SMALL", 2)
    rng, dim, n = np.random.default_rng(8), 192, 600
    centre, own = np.ones(dim) / np.sqrt(dim), rng.standard_normal((n, dim)) / np.sqrt(dim)
    own[500:] = own[200:300] + 0.9 * rng.standard_normal((100, dim)) / np.sqrt(dim)
    x = (centre + 0.42 * own).astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    label = np.arange(n)
    for _ in range(n):
        label = np.array([label[row].min() for row in link])
    assert 80 <= (link.sum() - n) / 2 <= 400
    rows = {r.vec_id: r for r in vectors.near_duplicate_vectors(frame(spark, x)).collect()}
    assert sum(rows[i].n_links for i in range(n)) >= 0.97 * (link.sum() - n)
    assert np.mean([rows[i].component_id == label[i] for i in range(n)]) >= 0.97


def exact_links(x: np.ndarray, threshold: float = 0.9) -> np.ndarray:
    u = x.astype(float) / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T >= threshold


@pytest.mark.parametrize(("n", "block"), [(1600, 4096), (3000, 512)])
def test_pairs_at_the_threshold_in_a_crowded_cone(spark, monkeypatch, n, block):
    monkeypatch.setattr(vectors, "BLOCK", block)  # the second is split by further projections
    rng, dim = np.random.default_rng(n), 128
    x = np.ones(dim) / np.sqrt(dim) + 0.5 * rng.standard_normal((n, dim)) / np.sqrt(dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n // 2, 2):  # half of them in pairs at cosine 0.90 to 0.91
        aside = rng.standard_normal(dim)
        aside -= aside @ x[i] * x[i]
        c = rng.uniform(0.9001, 0.91)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * aside / np.linalg.norm(aside)
    link = exact_links(x)
    label = np.arange(n)
    for _ in range(20):
        label = np.array([label[row].min() for row in link])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in vectors.near_duplicate_vectors(table).collect()}
    assert sum(rows[i].n_links for i in range(n)) >= 0.9 * (link.sum() - n)
    assert np.mean([rows[i + 1].n_links > 0 for i in range(0, n // 2, 2)]) >= 0.9
    assert np.mean([rows[i].component_id == label[i] for i in range(n)]) >= 0.95


def test_very_small_and_large_components(spark):
    x = [[1e-200, 2e-200, 0.0], [1.0, 2.0, 0.0], [1e200, 2.1e200, 1e190], [-1e200, 1e200, 1e200], [1e308, 1e308, -1e308], [5e-324, 0.0, 0.0], [2.0, 0.0, 0.0]]
    link = exact_links(np.array(x))
    rows = {r.vec_id: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()}
    assert [rows[i].n_links for i in range(len(x))] == (link.sum(1) - 1).tolist() == [2, 2, 2, 0, 0, 1, 1]
    assert [rows[i].component_id for i in range(len(x))] == [0, 0, 0, 3, 4, 5, 5]


def test_nearest_neighbours(spark):
    x = cloud(2, 1500)
    table = frame(spark, x)
    got: dict = {}
    for r in vectors.nearest_neighbours(table.filter("vec_id % 100 = 0"), table, least=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == pytest.approx([d[v] for _, v, _ in own])
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hits >= 0.9 * 150
    assert len(vectors.nearest_neighbours(table.filter("vec_id = 9006"), table).collect()) == 1
    assert vectors.nearest_neighbours(table.limit(0), table.limit(0)).collect() == []


def test_nearest_neighbours_with_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)  # several shards
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, (200, 4)).astype(float)
    x[~x.any(1)] = 1.0
    ids = [*range(190), *range(10)]  # ten ids come twice
    table = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vectors.nearest_neighbours(table.filter("vec_id in (50, 100, 150)"), table, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (50, 100, 150):
        want = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in zip(ids, x, strict=True) if i != q)[:10]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(s)) for s, i in want]


@pytest.mark.parametrize("sizes", [[200], [-170], [-320], [200, -170, 0], [307, -307]])
def test_nearest_neighbours_of_any_size(spark, sizes):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((120, 8)) * np.array([10.0 ** sizes[i % len(sizes)] for i in range(120)])[:, None] / 10
    table = spark.createDataFrame(list(zip(range(120), x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vectors.nearest_neighbours(table.filter("vec_id % 10 = 0"), table, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for q in range(0, 120, 10):
        want = sorted((math.dist(x[q].tolist(), v.tolist()), i) for i, v in enumerate(x) if i != q)[:10]
        assert [s for _, s, _ in sorted(got[q])] == pytest.approx([s for s, _ in want], rel=1e-12, abs=0)
        assert all(0 < s < math.inf for _, s, _ in got[q])
        if len(sizes) == 1:
            assert [i for *_, i in sorted(got[q])] == [i for _, i in want]


def test_distances_of_common_size_are_the_plain_formula():
    rng = np.random.default_rng(12)
    x, q = rng.standard_normal((500, 32)), rng.standard_normal(32)
    assert (vectors.distances(x, q) == np.sqrt(((x - q) ** 2).sum(1))).all()


def test_forest_finds_longest_prefix_first():
    x = cloud(5, 200).astype(float)
    forest = vectors.PrefixForest(x, 8, 1)
    strings = forest.strings(x)
    for q in range(0, 200, 20):
        found = set(forest.candidates(strings[q], 5).tolist())
        assert q in found and len(found) >= 5
        depth = [max((vectors.BITS - int(strings[q, t] ^ strings[r, t]).bit_length()) for t in range(8)) for r in range(200)]
        worst = min(depth[r] for r in found)
        assert all(r in found for r in range(200) if depth[r] > worst)


def test_pipeline_rows_without_id(spark):
    texts = [" ".join(f"w{i}_{j}" for j in range(50)) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts[:4])] + [(None, texts[0], "en", "s1", 1)] + [(None, texts[5], "en", f"s{i}", 1) for i in (0, 1, 1)]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), "").collect()]
    assert sorted(kept, key=str) == sorted([*enumerate(texts[:4]), (None, texts[5])], key=str)
    rows = [(None, texts[i // 3], "en", f"s{i % 2}", 1) for i in range(18)]
    docs = spark.createDataFrame(rows, schema)
    words = {r["source"]: r["target"] for r in corpus_pipeline.mixing.mix(docs).select("source", "target").distinct().collect()}
    taken = [(r.source, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    assert set(taken) == {(r[3], r[1]) for r in rows}
    assert all(sum(s == source for s, _ in taken) == words[source] // 50 for source in words)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(1)
    parts = {"en": ["an", "th", "er", "ing", "on"], "de": ["zu", "sch", "ü", "keit", "ver"]}
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    junk = [(1000 + i, " ".join(w.upper() + "%%%" for w in rows[i][1].split()), rows[i][2], "s0", 1) for i in range(80)]
    odd = [(2000, None, None, None, None), (2001, "", None, "s1", 0), (2002, "12 34 %", None, "s1", 7), (None, None, None, None, None)]
    copies = [(3000 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(20)]
    docs = spark.createDataFrame(rows + junk + odd + copies, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in junk], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, str(tmp_path))
        assert new.columns == docs.columns
        new.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r.doc_id for r in now.collect()]
    good = {r[0] for r in rows}
    assert len(good & set(ids["quality classifier"])) >= 238 and len({r[0] for r in junk} & set(ids["quality classifier"])) <= 2
    assert good & set(ids["quality classifier"]) <= set(ids["language identification"])
    assert not {2000, 2001, 2002, None} & set(ids["language identification"])
    kept = ids["near-duplicates"]
    assert len(kept) == len(set(kept)) and not any(i >= 3000 for i in kept) and good & set(ids["language identification"]) <= set(kept)
    assert 1.3 * len(kept) <= len(ids["mixing"]) <= 2 * len(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed if r.start == 0) == sorted(ids["mixing"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)


def test_pipeline_with_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    names = ["row", "score", "_score", "lang_pred", "_language", "key", "position", "positions", "id", "_n", "_key", "all", "rows", "u", "v", "node"]
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40)), "en", f"s{i % 2}", 1, *names) for i in range(30)] + [(None,) * (5 + len(names)), (40, None, "en", None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == docs.columns and all(tuple(r[5:]) == tuple(names) for r in now.collect() if r.doc_id is not None)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()} >= set(range(30))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stages_hand_few_texts_to_a_worker(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(key))
    try:
        for most, want in ((own, corpus_pipeline.TEXTS), (0, corpus_pipeline.TEXTS), (7, 7)):
            spark.conf.set(key, most)
            assert int(corpus_pipeline._few_at_once(lambda s, docs, d: s.conf.get(key))(spark, None, "")) == want
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(key, own)
