import functools
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relevanta.llm import chat, langid, mixing, near_dup, packing, quality, scoring, token_files
from relevanta.llm import lattice as lattice_module
from relevanta.llm.lattice import Lattice, lattice_of, load_pieces
from relevanta.llm.common import staged
from relevanta.llm.scoring import default_vocabulary
from relevanta.llm.tokens import default_tokenizer, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, word string, size string"
WORDS = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "tau", "zeta", "theta"]


def texts(seed: int, n: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(5, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", "y", "z") for i, t in enumerate(texts(1, 20))]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", None, 0, "", "", ""), (102, " \n\t", None, "s0", 3, "", "", "")]
    rows += [(None, "no id here at all", "en", "s1", 5, "", "", ""), (None, None, None, None, None, None, None, None)]
    rows += [rows[0], rows[0], (103, "long " * 30_000, "en", "s2", 1, "", "", ""), (104, "x" * 5000, None, "s2", 1, "", "", ""), (105, "a <|endoftext|> b<|endoftext|>", "en", "s1", 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@functools.lru_cache
def fresh() -> Tokenizer:
    """The library's own tokenizer, nothing set."""
    return Tokenizer.from_file(default_tokenizer())


def plain_ids(text: str | None) -> list[int]:
    return fresh().encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_piece_encoder_equals_tokenizer():
    rng = random.Random(3)
    parts = ["a", "the", "  ", " ", "\n", "\t", "!", "'s", "é", "1", "\x1c", "\x85", "<|endoftext|>", "Ġ", "\r\n", "漢", "😀", "don't", "x,", "é.", "²x"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(b, np.int32).tolist() for b in encoder(default_tokenizer()).encode(many)] == [e.ids for e in fresh().encode_batch(many, add_special_tokens=False)]
    assert 50256 in plain_ids("a <|endoftext|> b")
    plain, flagged = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer(), plain=True)
    plain.encode_special_tokens = True
    assert [np.frombuffer(b, np.int32).tolist() for b in flagged.encode(many)] == [e.ids for e in plain.encode_batch(many, add_special_tokens=False)]


def test_token_files(spark, odd, empty, tmp_path):
    token_files.write_token_files(odd, f"file://{tmp_path}/t")
    back = token_files.global_starts(token_files.read_token_files(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert len(back) == odd.count()
    at = 0
    for r in back:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
    assert [r.doc_id for r in back] == sorted((r.doc_id for r in back), key=lambda x: (x is not None, x or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((r.doc_id, (*plain_ids(r.text), 0)) for r in odd.collect())
    assert [r.doc_id for r in token_files.read_token_files(spark, f"file://{tmp_path}/t", [3]).collect()] == [3]
    report = token_files.token_file_report(odd).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in report) == Counter((r.doc_id, crc([*plain_ids(r.text), 0])) for r in odd.collect())
    assert token_files.token_file_report(empty).collect() == []


def test_packing_rule():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = packing.closest_fill(counts, room)
        assert all(n <= counts[x] for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    plan, total = packing.patterns(counts, 64), Counter()
    for times, used in plan:
        assert sum(x * n for x, n in used.items()) <= 64
        total.update({x: n * times for x, n in used.items()})
    assert total == Counter(counts)


def test_packing(odd, empty):
    pieces = packing.pack_documents(odd).collect()
    documents, sequences = Counter(), defaultdict(list)
    for r in pieces:
        assert len(r.ids) == r.length <= 2048
        sequences[r.sequence_id].append(r)
        documents[r.doc_id] += r.length
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len(plain_ids(r.text)) + 1
    assert documents == want
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) == math.ceil(sum(want.values()) / 2048)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packing.packing_report(odd).collect()) == Counter((r.doc_id, r.start, crc(r.ids)) for r in pieces)
    assert packing.packing_report(empty).collect() == []


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    targets = {r.source: (r.target, r.source_size) for r in rows}
    sizes = Counter()
    for r in odd.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    # shared by weight, filled up to the caps again and again
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(order, [3.0, 1.0, 2.0, 3.0], strict=True))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not above:
            want |= {s: level * weights[s] for s in open_}
            break
        for s in above:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= above
    for s in order:
        assert targets[s][1] == sizes[s] and targets[s][0] == pytest.approx(want[s])
    for r in rows:
        assert r.taken == r.repeats * r.size <= 2 * r.size and len(r.positions) == r.repeats
        assert all(0 <= p <= 1 for p in r.positions)
    many = spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in enumerate(texts(2, 800))], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(many).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    assert sorted(map(tuple, mixing.mixing_report(many.repartition(7)).collect())) == sorted(map(tuple, mixing.mixing_report(many).collect()))
    at = [r.position for r in mixing.curriculum(mixing.mix(many)).collect()]
    assert at == sorted(at) and mixing.mix(empty).collect() == []


def test_inverted_demand(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.2), (0.3, 2.0), (1.0, 0.0))
    grid = np.linspace(0, 1, 200_001)
    area = np.cumsum(np.interp(grid, *zip(*knots, strict=True)))
    shares = [0.0, 0.1, 0.33, 0.7, 0.999, 1.0]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert_demand(F.col("s"), knots).alias("t")).collect()
    for s, r in zip(shares, got, strict=True):
        assert r.t == pytest.approx(np.interp(s, area / area[-1], grid), abs=2e-3)


def test_scoring_counts(odd, empty):
    rows = scoring.scoring_report(odd).collect()
    train, ends = Counter(), 0
    raw = odd.collect()
    for r in raw:
        if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 != 2:
            train.update((r.text or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    want = Counter()
    for r in raw:
        own = (r.text or "").encode().lower().split()
        want[(r.doc_id, len(own) + 1, sum(train[w] > 0 for w in own) + 1, round(sum(map(log, (train[w] for w in own))) + log(ends), 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score <= 0 and math.isfinite(r.lattice_score) for r in rows)
    assert scoring.scoring_report(empty).collect() == []


def brute(word: bytes, known: dict) -> float:
    at = [0.0] + [-math.inf] * len(word)
    for i in range(1, len(word) + 1):
        at[i] = np.logaddexp.reduce([at[j] + known[word[j:i]] for j in range(i) if word[j:i] in known] or [-math.inf])
    return at[-1]


def test_copies_stand_all_over_their_source(spark):
    rows = [(7, "a b c", "s", i) for i in range(3000)] + [(None, "d e", "s", i) for i in range(500)] + [(i, f"w{i} x", "s", i) for i in range(100, 400)] + [(8, "", "s", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(4)
    sized = docs.select("doc_id", "source", F.when(F.col("text") == "", 0).otherwise(2).cast("long").alias("size"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("row"))
    first, again = (mixing.order_places(staged(x, "rows"), 17).orderBy("doc_id", "_u") for x in (sized, sized.repartition(2)))
    places = [(r["doc_id"], r["_u"]) for r in first.filter("size > 0").collect()]
    assert len(set(places)) == 3800 and places == [(r["doc_id"], r["_u"]) for r in again.filter("size > 0").collect()]
    hot = [u for i, u in places if i == 7]
    assert all(600 < sum(a <= u < a + 0.25 for u in hot) < 900 for a in (0, 0.25, 0.5, 0.75))
    out = mixing.mixing_report(docs).collect()
    assert len(out) == len(rows) and abs(sum(r.taken for r in out) - out[0].target) <= 3 and all(r.taken <= 2 * r.size for r in out)


def test_long_words_in_the_lattice():
    lattice, rng = lattice_of(default_vocabulary()), random.Random(5)
    words = [bytes(rng.choice(b"etaoinshrdlu0123=") for _ in range(n)) for n in [1, 2, 30, 63, 64, 64]]
    assert lattice.log_probability(words)[0].tolist() == [lattice._long(w) for w in words]
    blocks = bytes(rng.choice(b"etaoin") for _ in range(300))
    whole = lattice._long(blocks)
    try:
        lattice_module.BLOCK = 7  # a word over many blocks
        assert lattice._long(blocks) == whole
    finally:
        lattice_module.BLOCK = 32_768
    for size, most in ((100_000, 2.0), (1_000_000, 10.0)):
        began = time.process_time()
        value = lattice.log_probability([bytes(rng.choice(b"etaoinshrdlu0123=") for _ in range(size))])[0][0]
        assert -20 * size < value < 0 and time.process_time() - began < most
    unspaced = "漢字仮名交じり文の例".encode()
    assert lattice.log_probability([unspaced * 4])[0][0] < lattice.log_probability([unspaced * 2])[0][0] < 0


def test_lattice_against_brute_force():
    pieces, logp = load_pieces(scoring.default_vocabulary())
    known = dict(zip(pieces, logp, strict=True))
    words = [w.encode() for w in ["there", "é", "thandion", "x" * 40, "漢字😀", "a", "responsibilities"]]
    whole = np.array([-3.0, -math.inf, -40.0, -math.inf, -2.0, -math.inf, -9.0])
    alone, marginal = Lattice(pieces, logp).log_probability(words, whole, -0.7)
    want = [brute(b" " + w, known) for w in words]
    assert alone == pytest.approx(want) and np.exp(logp).sum() == pytest.approx(1)
    assert marginal == pytest.approx(np.logaddexp(whole, np.array(want) - 0.7))


def test_scores_against_brute_force(odd):
    known = dict(zip(*load_pieces(scoring.default_vocabulary()), strict=True))
    raw = odd.collect()
    learn = [zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 != 2 for r in raw]
    train = Counter(w for r, own in zip(raw, learn, strict=True) if own for w in (r.text or "").encode().lower().split())
    n, ends = sum(train.values()) + sum(learn), sum(learn)
    by_count = Counter(train.values())
    discount = min(0.95, by_count[1] / (by_count[1] + 2 * by_count[2]))

    def score(word: bytes) -> float:
        whole = math.log((train[word] - discount) / n) if train[word] else -math.inf
        return np.logaddexp(whole, brute(b" " + word, known) + math.log(discount * len(train) / n)) / math.log(10)

    want = Counter()
    memo: dict = {}
    for r in raw:
        total = math.log10(ends / n)
        for w in (r.text or "").encode().lower().split():
            if w not in memo:
                memo[w] = score(w)
            total += memo[w]
        want[r.doc_id, round(total, 3)] += 1
    assert Counter((r.doc_id, round(r.score, 3)) for r in scoring.scoring_report(odd).collect()) == want
    # all mass: whole words, the end, and what the pieces share
    assert sum((c - discount) / n for c in train.values()) + ends / n + discount * len(train) / n == pytest.approx(1)


def test_language(spark, odd, empty):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [(i, make(["an", "th", "er"]) if i % 2 else make(["zu", "sch", "ü"]), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_report(docs).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    report = langid.language_report(odd).collect()
    assert len(report) == odd.count() and {r.lang_pred for r in report if r.doc_id in (100, 101, 102)} == {"und"}
    assert langid.language_report(empty).collect() == []


def test_quality(spark, odd, empty):
    rng = random.Random(6)
    good = texts(7, 150)
    bad = [" ".join(w.upper() + rng.choice(["!!", "%%%", "$$$"]) for w in t.split()) for t in texts(8, 150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = quality.quality_report(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == int(r.doc_id < 150) for r in rows if r.held_out) >= 0.95 * sum(r.held_out for r in rows)
    assert len(quality.quality_report(odd, labels.limit(0)).collect()) == odd.count()
    assert len(quality.quality_report(odd, labels).collect()) == odd.count()
    assert quality.quality_report(empty, labels).collect() == []


def test_quality_against_brute_force(spark):
    """Scores from raw compressed sizes, and weights at the optimum of the regression."""
    import zstandard

    rng = random.Random(16)
    good = texts(17, 120)
    bad = [" ".join(w.upper() + rng.choice(["!!", "%%%"]) if rng.random() < 0.6 else w for w in t.split()) for t in texts(18, 120)]
    docs = spark.createDataFrame([*enumerate(good + bad), (900, None), (901, "")], "doc_id long, text string")
    # 240 is labelled both ways and teaches nothing, and so does 241 with another label
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(0, 1), (1, 0), (901, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)

    def size(dictionary: bytes, text: bytes) -> int:
        z = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(dictionary))
        return sum(len(z.compress(text[i : i + quality.BLOCK])) for i in range(0, max(len(text), 1), quality.BLOCK))

    def x(text: str) -> list[float]:
        raw = (text or "").encode()
        n, g, b = len(raw) + max(1, -(-len(raw) // quality.BLOCK)), size(model.good, raw), size(model.bad, raw)
        return [(g - b) / max(g, b), g / n, b / n]

    scale = lambda rows: np.c_[(np.array(rows) - model.mean) / model.spread, np.ones(len(rows))]
    probability = lambda a: 1 / (1 + np.exp(-(a @ np.array(model.weights))))
    want = dict(zip([*range(240), 900, 901], probability(scale([x(t) for t in [*good, *bad, None, ""]])), strict=True))
    got = {r.doc_id: r.score for r in quality.add_quality(docs, model).collect()}
    assert got == pytest.approx(want)
    assert np.mean([(got[i] >= 0.5) == (i < 120) for i in range(240)]) >= 0.97
    # a third of the rows made the dictionaries; over the others the penalised gradient is 0
    drawn = quality.first_of_each(quality.sampled(docs.join(labels.filter("doc_id between 2 and 239 or doc_id = 0").distinct(), "doc_id").withColumnsRenamed({"doc_id": "_id", "quality": "_label"}), "_label", ["_id", "text"], 2000, 9), "_label", 2000).filter("_rank % 3 <> 1").collect()
    a, y = scale([x(r.text) for r in drawn]), np.array([r._label for r in drawn])
    penalty = 1e-3 * len(y) * np.array([1, 1, 1, 1e-6])
    assert np.abs(a.T @ (probability(a) - y) + penalty * model.weights).max() < 1e-6 * len(y)


def test_language_against_brute_force(spark):
    """With every row a landmark the Nyström map is exact: kernel ridge regression from sets of n-grams gives the margins."""
    rng = random.Random(14)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(8))
    rows = [(i, make(["an", "th", "er"]) if i % 2 else make(["zu", "sch", "ü"]), "en" if i % 2 else "de") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=1000)

    def grams(text: str) -> set:
        raw, out = b" " + text.lower().encode().translate(langid._PLAIN) + b" ", set()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                value = 0
                for byte in raw[i : i + n]:
                    value = (value * 257 + byte) % 2**32
                out.add((value * 2654435761 % 2**32) >> 18)
        return out

    sets = [grams(t) for _, t, _ in rows]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[lang == x for x in ("de", "en")] for _, _, lang in rows], float)
    centre = np.eye(40) - 1 / 40
    alpha = np.linalg.solve(centre @ k @ centre + 1e-2 * np.eye(40), y - y.mean(0))
    for text in [make(["an", "th", "er"]), make(["zu", "sch", "ü"]), "an zu", "x"]:
        own = np.array([kernel(grams(text), s) for s in sets])
        margins = y.mean(0) + (own - k.mean(0)) @ centre @ alpha
        names, scores = langid.predict([text], model)
        assert names == [("de", "en")[margins.argmax()]] and scores[0] == pytest.approx(min(1.0, max(0.0, margins.max())), abs=1e-3)
    assert langid.predict(["1 2 3", None, ""], model)[0] == ["und"] * 3


def test_samples_that_no_id_can_crowd(spark):
    """Thousands of rows without an id, and a row that repeats thousands of times."""
    rng = random.Random(15)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(8))
    rows = [(None, make(["an", "th", "er"]), "en") for _ in range(3000)] + [(i, make(["zu", "sch", "ü"]), "de") for i in range(300)] + [(7, "ein zu sch", "de")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.add_language(docs, langid.fit(docs)).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred) for r in got} == {("en", "en"), ("de", "de")}
    from relevanta.llm.common import first_of_each, sampled

    drawn = sampled(docs, "lang", ["doc_id", "text"], 100, 6)
    assert drawn.filter("lang = 'en'").count() <= 400
    counts = {r.lang: r["count"] for r in first_of_each(drawn, "lang", 100).groupBy("lang").count().collect()}
    assert counts == {"en": 100, "de": 100}


def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch):
    """Two texts that are alike, though what their leader lacks of them has no run of two words in common."""
    passage = [f"p{i}" for i in range(600)]
    tails = [[f"t{n}x{i}" for i in range(200)] for n in range(200)]
    tails[101] = [x if i % 2 else tails[100][i] for i, x in enumerate(tails[101])]
    docs = spark.createDataFrame([(n, " ".join(passage + x)) for n, x in enumerate(tails)], "doc_id long, text string")
    for block in (near_dup.BLOCK, 16):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert {r.doc_id for r in near_dup.near_duplicates(docs).collect() if not r.kept} == {101}


def test_near_duplicates(spark, odd, empty):
    rng, rows, groups = random.Random(9), [], []
    for i, t in enumerate(t for t in texts(10, 60, 120) if t.count(" ") > 35):
        own = t.split()
        rows.append((i, t))
        near = list(own)
        for _ in range(max(1, len(own) // 15)):
            near[rng.randrange(len(near))] = "changed"
        rows += [(1000 + i, " ".join(near)), (2000 + i, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    own = {i: t.lower().encode().split() for i, t in rows}
    for a in own:
        for b in own:
            if a < b and near_dup.alike(own[a], own[b], 0.8):
                groups.append((a, b))
    parent = {i: i for i in own}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in groups:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in own}
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[101].component_id == 100 and by_id[100].kept and by_id[None].component_id is None and by_id[None].kept
    assert near_dup.near_duplicates(empty).collect() == []


def changed(rng, own: list, edits: int) -> list:
    near = list(own)
    for i in rng.sample(range(len(own)), edits):
        near[i] = f"changed{rng.random()}"
    return near


def test_large_bucket(spark, monkeypatch):
    sketch = near_dup.sketch_documents
    one = lambda *args: sketch(*args).withColumn("sketches", F.array(F.lit(7).cast("long"))).withColumn("short_sketches", F.array().cast("array<long>"))
    monkeypatch.setattr(near_dup, "sketch_documents", one)  # all texts meet in one bucket
    rng = random.Random(4)
    passage = [f"p{rng.randrange(500)}" for _ in range(100)]
    own = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(60)]
    rows = [(i, " ".join(passage + x)) for i, x in enumerate(own)] + [(100 + i, " ".join(passage + changed(rng, own[i], 9))) for i in range(30, 60)]
    # with more texts than are compared completely, and with fewer
    for complete in (16, 128):
        monkeypatch.setattr(near_dup, "COMPLETE", complete)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(got[i] != (i - 100 if i >= 100 else i) for i, _ in rows) <= 1
    # many near copies of one text
    rows = [(i, " ".join(changed(rng, own[0] * 2, 8))) for i in range(150)]
    monkeypatch.setattr(near_dup, "COMPLETE", 16)
    assert {r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_near_copies_need_a_pair_a_text(spark, monkeypatch):
    asked, verified = [], near_dup.verified

    def counted(pairs, *args):
        asked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near_dup, "verified", counted)
    rng = random.Random(30)
    own = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(changed(rng, own, 6))) for i in range(50)]
    assert {r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert sum(asked) <= 100, asked


def test_finer_bags_rule_out_what_bags_do_not():
    """Unlike texts with a long run of one line; copies with a few changes stay."""
    rng = random.Random(31)
    words = [["is", "onhe."] * 300 + [f"o{rng.random()}" for _ in range(200)] for _ in range(2)]
    texts = [" ".join(x) for x in (*words, changed(rng, words[0], 100))]
    hashes, counts = near_dup.word_hashes(texts)
    fine = near_dup._fine_matrix(pa.array(near_dup.fine_bags(hashes, counts), pa.binary()))
    assert fine.sum(1).tolist() == counts.tolist()
    for bag, want in ((near_dup.bags(hashes, counts), [True, True]), (fine, [False, True])):
        assert near_dup.may_be_alike(bag[[0, 0]], bag[[1, 2]], counts[[0, 0]], counts[[1, 2]], 0.8).tolist() == want


def test_a_large_bucket_hands_on_links_and_no_pairs():
    """Copies of one text, each a class of its own, and unlike texts: a link for each copy, whatever pairs there are; a pair that
    another bucket aligns is left to it."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(changed(rng, base, 6)) for _ in range(60)] + [" ".join(f"t{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    texts.sort(key=lambda t: len(t.split()))
    n, node = np.array([len(t.split()) for t in texts]), np.arange(len(texts)) * 7
    links = near_dup.links_of_group(n, node, node, texts, lambda a, b: True, 0.8)
    assert len(links) == 59 and all(near_dup.alike(*(texts[x // 7].split() for x in link), 0.8) for link in links)
    far = [" ".join([f"x{i}" if i < 36 else w for i, w in enumerate(base)]), " ".join(base)]
    for mine in (True, False):
        assert len(near_dup.links_of_group(np.array([200, 200]), np.arange(2), np.arange(2), far, lambda a, b: mine, 0.8)) == mine  # noqa: B023


def test_finer_bags_spare_long_texts(spark):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(9000)}" for _ in range(4000)) for _ in range(2)]
    texts.append(" ".join(changed(rng, texts[0].split(), 100)))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = spark.createDataFrame([(0, 1, 2, False), (0, 1, 2, True), (0, 2, 1, False)], "u long, v long, met long, hot boolean")
    assert sorted(tuple(r) for r in near_dup.finer(pairs, rows, 0.8).collect()) == [(0, 1, 0, True), (0, 2, 1, False)]


def test_joined_at_the_threshold(spark):
    """Pairs of 100-word texts with 15 % and 19 % of their words changed at random."""
    rng, rows = random.Random(12), []
    for at in range(400):
        own = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows += [(2 * at, " ".join(own)), (2 * at + 1, " ".join(changed(rng, own, 15 if at % 2 else 19)))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in (0, 1):
        assert np.mean([got[2 * at] == got[2 * at + 1] for at in range(400) if at % 2 == k]) >= 0.97


def test_pairs_in_shared_boilerplate(spark):
    """Texts that share 65 % of their words in one to three levels (all, one of 3, one of 9), pairs at 0.82."""
    rng, rows = random.Random(21), []
    for levels in (1, 2, 3):
        shared = {(k, j): [f"l{levels}k{k}j{j}w{rng.randrange(10**6)}" for _ in range(90 // levels)] for k in range(levels) for j in range(3**k)}
        for at in range(150):
            own = [w for k in range(levels) for w in shared[k, at % 3**k]] + [f"o{rng.randrange(10**6)}" for _ in range(50)]
            base = 2 * (150 * (levels - 1) + at)
            rows += [(base, " ".join(own)), (base + 1, " ".join(changed(rng, own, int(0.18 * len(own)))))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for levels in (1, 2, 3):
        own = range(300 * (levels - 1), 300 * levels, 2)
        assert np.mean([got[i] == got[i + 1] for i in own]) >= 0.97, levels
        assert len({got[i] for i in own}) >= 140, levels  # boilerplate alone joins nothing


def test_alike_texts_meet_in_a_sketch(spark):
    rng, rows, lengths = random.Random(6), [], (5, 10, 15, 20, 30, 38, 40, 45, 49, 50, 60, 100, 200, 500)
    kinds = [(n, s, i) for n in lengths for s in (0.8, 0.82, 0.85, 0.9) for i in range(120)]
    for at, (n, s, i) in enumerate(kinds):
        own = [f"w{rng.randrange(5000)}" for _ in range(n)]
        edits = int((1 - s) * n + 1e-9)
        near = changed(rng, own, edits)
        if i % 3 == 0:  # words taken out
            near = [x for x in near if not x.startswith("changed")]
        if i % 3 == 1 and edits:  # as far from one another as they can be
            near = [f"c{rng.random()}" if j % (n // edits) == 2 and j // (n // edits) < edits else x for j, x in enumerate(own)]
        assert near_dup.alike(own, near, 0.8)
        rows += [(2 * at, " ".join(own)), (2 * at + 1, " ".join(near))]
    got = near_dup.sketch_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.concat("sketches", "short_sketches").alias("keys")).collect()
    keys = {r.doc_id: set(r.keys) for r in got}
    for n in lengths:
        own = [at for at, kind in enumerate(kinds) if kind[0] == n]
        assert np.mean([bool(keys[2 * at] & keys[2 * at + 1]) for at in own]) >= 0.99, n


def test_banded_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcd") if rng.random() < 0.3 else x for x in a if rng.random() < 0.9] + [rng.choice("abcd")] * rng.randint(0, 2)
        most = rng.randint(0, 8)
        assert near_dup.banded_distance(a, b, most) == min(plain(a, b), most + 1)


def test_chat_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "he"), (1, 4, "delta", 1, None, "llo"),
        (1, 5, "message", 2, "user", "more"), (1, 6, "message", 3, "assistant", "old"), (1, 7, "regenerate", 1, None, "new"), (1, 8, "delta", 1, None, "er"),
        (1, 9, "message", 4, "user", "next"), (1, 10, "edit", 0, None, "HI"), (1, 11, "delta", 9, None, "lost"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.fold_events(log).orderBy("turn").collect()]
    assert got == [(0, "user", "HI"), (1, "assistant", "newer"), (2, "user", "next")]


def test_chat_round_trip(spark):
    rng, parts = random.Random(2), [*chat.CONTROLS, "\\", "\\\\", "a", "\n", " ", "é", "<", "|", "s>"]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", parts[0], None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(400)]
    rows += [(7, 2, "user", None), (None, None, None, None), (500, 0, "assistant", "y" * 50_000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, segment string, msg string")
    got = {r.conv_id: r for r in chat.chat_report(table).collect()}
    conversations = defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        conversations[conv].append((turn if turn is not None else -1, role is not None, role or "", text or ""))
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learned = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert [r.conv_id for r in chat.chat_report(table.limit(0)).collect()] == [-7]
