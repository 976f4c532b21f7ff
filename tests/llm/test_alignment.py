import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevanta.llm import alignment
from relevanta.llm.tokens import default_tokenizer

DOCS = "doc_id long, text string, part string, number int, a string, planes string"
PARTS = ["a", "the", "  ", " ", "\n", "\t", "!", "'s", "é", "1", "\x1c", "\x85", "<|endoftext|>", "Ġ", "\r\n", "漢", "😀", "don't", "x,", "é.", "²x", "</s>", "<s>", "▁", ";\r", "\0", "<0x0A>"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def byte_table() -> dict[str, int]:
    """Letters of byte-level BPE: printable bytes are themselves, the others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts: list, a, b) -> list[tuple]:
    """The contract's columns after doc_id, byte by byte."""
    table, docs = byte_table(), []
    for text in texts:
        tokens_a, tokens_b = [], []
        if text:
            tokens_a = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            tokens_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            raw = (" " + text).encode()
            if b"".join(x for _, x in tokens_a) != raw or b"".join(x for _, x in tokens_b) != raw:
                tokens_a, tokens_b = [], []
        owner_a, owner_b = ([n for n, (_, x) in enumerate(t) for _ in x] for t in (tokens_a, tokens_b))
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, x, y = [], 0, 0
        for at in range(len(owner_a)):
            last = at + 1 == len(owner_a)
            if last or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]):
                groups.append(",".join(str(i) for i, _ in tokens_a[x : owner_a[at] + 1]) + "|" + ",".join(str(i) for i, _ in tokens_b[y : owner_b[at] + 1]))
                x, y = owner_a[at] + 1, owner_b[at] + 1
        docs.append((len(tokens_a), len(tokens_b), groups, Counter((tokens_a[i][0], tokens_b[j][0]) for i, j in links)))
    counts, most = Counter(), defaultdict(int)
    for *_, links in docs:
        counts.update(links)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), sum(links.values()), sum(m for p, m in links.items() if counts[p] == most[p[1]]), sum(m * counts[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in docs
    ]


def got(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_alignment_equals_brute_force(spark, models):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [" ".join(rng.choice(["alpha", "unalphabetisch", "x,", "don't", "\nline"]) for _ in range(40)) for _ in range(100)]
    texts += [None, "", " ", "▁", "the " * 30_000, "y" * 20_000, *texts[:20]]
    rows = [(i, t, "p", 1, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (0, "the id of another", None, None, None, None)]
    expected = brute([r[1] for r in rows], *models)
    out = got(alignment.alignment_report(spark.createDataFrame(rows, DOCS).repartition(3)))
    assert sorted(out, key=str) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=str)
    assert got(alignment.alignment_report(spark.createDataFrame([], DOCS))) == []


def test_words_alone_equal_whole_texts():
    rng, codec = random.Random(6), alignment.Aligner(default_tokenizer(), alignment.default_pieces())
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9)))
        found, n = codec.entries([text])[0], codec.whole(text)
        assert [codec.groups[i] for i in ([n] if n >= 0 else [])] == ([";".join(codec.groups[i] for i in found)] if found else [])


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3, 1.0])
def test_planes_hold_documents_and_multiplicities(share):
    rng = np.random.default_rng(7)
    times = [np.where(rng.random(alignment.CHUNK) < share, rng.integers(1, 40, alignment.CHUNK), 0) for _ in range(3)]
    key = np.concatenate([np.flatnonzero(t) for t in times])
    blobs = alignment.encode_planes(key, np.array([np.count_nonzero(t) for t in times]), np.concatenate([t[t > 0] for t in times]), 3)
    for blob, t in zip(blobs, times, strict=True):
        back = np.zeros(alignment.CHUNK, int)
        for k, numbers in alignment.decode_planes(blob):
            back[numbers] += 1 << k
        assert (back == t).all()
        assert alignment.popcount(alignment.document_bits(blob)) == np.count_nonzero(t)
    merged = alignment.or_merge([alignment.document_bits(b) for b in blobs])
    assert alignment.popcount(merged) == np.count_nonzero(sum(times))


def test_counts_of_the_index(spark, models, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "alphabet", "bet", "unalphabetisch"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    path = f"file://{tmp_path}/index"
    alignment.write_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path)
    index = spark.read.parquet(path).filter(F.col("kind") == "pair")
    codec, docs, links, with_b = alignment.Aligner(default_tokenizer(), alignment.default_pieces()), Counter(), Counter(), Counter()
    for text in texts:
        n = codec.whole(text)
        pairs = Counter((x >> 32, x & 0xFFFFFFFF) for x in codec.links[codec.starts[n] : codec.starts[n + 1]])
        links.update(pairs)
        docs.update(pairs.keys())
        with_b.update({b for _, b in pairs})
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(index).collect()} == {p: (docs[p], links[p]) for p in docs}
    assert {r["b"]: r["n_docs"] for r in alignment.documents_with(index, "b").collect()} == dict(with_b)
