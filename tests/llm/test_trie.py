import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relevanta.llm import trie

TURNS = "conv_id long, turn long, role string, text string, path string, sizes int, shard int"


def brute(rows) -> list[tuple]:
    """The contract's rows, from every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)

    out, sub = [], {}
    for n in sorted(members, key=len, reverse=True):
        size = len(n[-1][1].encode()) if n else 0
        leaves = sum(sub[k][0] for k in kids[n]) or 1
        sub[n] = leaves, (len(members[n]) - 1) * size + sum(sub[k][1] for k in kids[n])
        ends = ",".join(str(c) for c in sorted(members[n]) if built[c] == n)
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *sub[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_rows(seed: int, convs: int) -> list[tuple]:
    """A third of the conversations are copies of one, another third begins like it; turns repeat and lack values."""
    rng, rows = random.Random(seed), []
    hot = [("user", f"é {i}") for i in range(6)]
    for c in rng.sample(range(-20, 3 * convs), convs):
        kind = rng.randrange(3)
        own = hot if kind == 0 else hot[: rng.randint(1, 6)] + [("assistant", rng.choice("ab"))] * rng.randint(0, 3) if kind == 1 else [(rng.choice(["user", None]), rng.choice(["x", "y", "", None])) for _ in range(rng.randint(1, 9))]
        rows += [(c, rng.choice([i, i, i, None]), role, text, "p", 1, 2) for i, (role, text) in enumerate(own)]
    rows += [(None, 0, "user", "nobody's", None, None, None), (3, None, None, None, None, None, None)]
    return rows + rows[:5]


@pytest.mark.parametrize("shards", [1, 2, 9])
def test_trie_equals_brute_force(spark, shards):
    rows = random_rows(shards, 150)
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    paths = trie.conversation_paths(turns)
    base = F.col("conv_id") - F.col("conv_id") % 5
    nodes = trie.prefix_trie(trie.rebuilt(paths, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9), shards)
    assert got(nodes) == brute(rows)


def test_report_on_odd_tables(spark):
    assert got(trie.trie_report(spark.createDataFrame([], TURNS))) == []
    assert got(trie.trie_report(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], TURNS))) == []
    long = [(7, i, "user", "w" * (i % 7), None, None, None) for i in range(3000)] + [(5, i, "user", "v", None, None, None) for i in range(20)] + [(8, 0, None, "t" * 1_000_000, None, None, None)]
    assert got(trie.trie_report(spark.createDataFrame(long, TURNS))) == brute(long)


def test_splitters_part_copies_and_long_paths_are_cut(spark, monkeypatch):
    copies = [(c, i, "user", str(i), None, None, None) for c in range(400) for i in range(5)]
    paths = trie.conversation_paths(spark.createDataFrame(copies, TURNS))
    cuts = trie.choose_splitters(paths, 8)
    assert len(cuts) == 7 and len({p for p, _ in cuts}) == 1
    monkeypatch.setattr(trie, "SPLITTER_BYTES", 8 * trie.SYMBOL)
    assert {len(p) for p, _ in trie.choose_splitters(paths, 8)} == {trie.SYMBOL}
    assert got(trie.prefix_trie(paths, 8)) == sorted(((0, d, 0 if d else None, 400, int(d < 5), 1, 399 * (6 - max(d, 1)), hashlib.sha256(",".join(map(str, range(400))).encode() if d == 5 else b"").hexdigest()) for d in range(6)), key=str)


def test_ends_of_a_hot_node_travel_in_pieces(spark):
    copies = [(c, 0, "user", "same", None, None, None) for c in range(20_000)]
    ends = {r["depth"]: r["ends_sha256"] for r in trie.prefix_trie(trie.conversation_paths(spark.createDataFrame(copies, TURNS)), 4).collect()}
    assert ends[1] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
