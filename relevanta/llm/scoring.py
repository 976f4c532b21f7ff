"""Log-probability of whole documents under a subword lattice.

A text is its white-space words, A-Z in lower case, and one end. A word's probability is the sum over all its
segmentations: into pieces of an existing byte-level subword vocabulary, each with the vocabulary's own score, or along
one more arc that spans the word if the training text has it. Whole words share the mass that absolute discounting leaves
them, the pieces get the rest, so every byte string has a probability and all of them sum to one. The sum is computed by
one forward recursion in log space, once for each distinct word of the corpus.

Word counts are one distributed table over all documents. The scores of its ``head`` most frequent words (each at most 64
bytes long) are broadcast, a bound that doesn't grow with the input; all other words of a document meet the table in an
ordinary join and are summed up by document.

Defined results: a null text is empty and holds the end alone; null ids and repeated rows are scored like others, a row
out for each row in; without any training text known counts are 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.llm.common import chunks, held_out, staged, texts_of
from relevanta.llm.lattice import lattice_of

HEAD = 1 << 17
#: Distinct words a task holds before it hands on their counts.
HELD = 400_000
LONGEST_HEAD_WORD = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_counts(docs: DataFrame, train_col: str, text_col: str = "text") -> DataFrame:
    """``(word, c, seen)`` of all distinct words: training tokens and all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(train: Counter, other: Counter) -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = np.fromiter(map(train.get, words, repeat(0)), np.int64, len(words))
            rest = np.fromiter(map(other.get, words, repeat(0)), np.int64, len(words))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(c + rest)], names=["word", "c", "seen"])

        train, other = Counter(), Counter()
        for batch in batches:
            for text, learn in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (train if learn else other).update(words_of(text))
                if len(train) + len(other) > HELD:
                    yield flush(train, other)
                    train, other = Counter(), Counter()
        if train or other:
            yield flush(train, other)

    return docs.select(text_col, train_col).mapInArrow(run, "word binary, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _by_batch(words: DataFrame, make, schema: str) -> DataFrame:
    """``make(words, counts)`` gives the columns of a batch of word rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch), names=names)

    return words.mapInArrow(run, schema)


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The words above a frequency that at most ``most`` words reach: the frequency is read off a histogram of a few
    hundred steps, so that no task hands on more than its own share of them."""
    step = F.floor(F.log2(F.greatest("seen", F.lit(1))) * 16).cast("int")
    counts = {r["step"]: r["n"] for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, taken = max(counts, default=0) + 1, 0
    for at in sorted(counts, reverse=True):
        if taken + counts[at] > most:
            break
        least, taken = at, taken + counts[at]
    return table.filter(step >= least)


def score_documents(docs: DataFrame, train_col: str, vocabulary: str | None = None, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score)`` for every row of ``docs``.

    ``train_col`` is true for the rows to learn from. ``base_score`` is the add-one unigram log10 probability.
    ``lattice_score`` is the dealt method by itself: the marginal over all segmentations into pieces of the vocabulary.
    ``score`` is a mixture: the same marginal with one more arc for each training word, which spans the word and is
    weighed by its discounted count; those arcs decide most of it (README has the three figures side by side).
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(train_col).alias("train"))
    words = staged(word_counts(docs, "train"), "words")
    ends = docs.filter("train").count()
    totals = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    tokens, types = totals["n"] + ends, totals["v"] + (ends > 0)
    discount = min(0.95, totals["n1"] / (totals["n1"] + 2 * totals["n2"])) if totals["n1"] else 0.5
    rest = discount * totals["v"] / tokens if totals["n"] else 0.5
    base_of = math.log10(tokens + types + 1)
    end_scores = (math.log10(ends + 1) - base_of, math.log10(ends / tokens) if ends and totals["n"] else math.log10(0.5), math.log10(ends / tokens) if ends and totals["n"] else math.log10(0.5))

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        c = batch.column(1).to_numpy()
        whole = np.where(c > 0, np.log(np.maximum(c - discount, 0.05) / max(tokens, 1)), -np.inf)
        pieces, marginal = lattice_of(vocabulary).log_probability(batch.column(0).to_pylist(), whole, math.log(rest))
        alone = pieces + math.log1p(-ends / tokens if ends and totals["n"] else -0.5)
        return [batch.column(0), batch.column(1), batch.column(2), pa.array(np.log10(c + 1.0) - base_of), pa.array(marginal / math.log(10)), pa.array(alone / math.log(10))]

    table = staged(_by_batch(words.select("word", "c", "seen"), scored, "word binary, c long, seen long, base double, score double, alone double"), "scored-words")
    # The head's size is bounded: at most ``head`` words of LONGEST_HEAD_WORD bytes.
    top = _most_frequent(table.filter(F.length("word") <= LONGEST_HEAD_WORD), head).collect()
    values = np.array([(r["c"] > 0, r["base"], r["score"], r["alone"]) for r in top] + [(0, 0.0, 0.0, 0.0)])
    shared = docs.sparkSession.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, values))
    edge = F.col("word").isNull()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with what its head words add up to, and a row for each of its other words."""
        places, numbers = shared.value
        names = ["doc_id", "h", "word", "times", "copies", "n_tokens", "n_known", "base", "score", "alone"]
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts, 4_000_000):
                owner, others, times, sums = [], [], [], np.zeros((j - i, 5))
                for k in range(i, j):
                    own = words_of(texts[k])
                    at = np.fromiter(map(places.get, own, repeat(-1)), np.int64, len(own))
                    sums[k - i] = len(own) + 1, *numbers[at].sum(0)
                    if len(missing := np.flatnonzero(at < 0)):
                        rare = Counter([own[m] for m in missing])
                        owner += [k - i] * len(rare)
                        others += rare.keys()
                        times += rare.values()
                n, m, take = j - i, len(others), pa.array(np.r_[np.arange(j - i), owner].astype(np.int64))
                padded = lambda x, m=m: np.r_[x, np.zeros(m, np.asarray(x).dtype)]
                ids, h = (batch.column(c).slice(i, n).take(take) for c in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [ids, h, pa.array([None] * n + others, pa.binary()), pa.array(np.r_[np.zeros(n, np.int64), np.array(times, np.int64)]), pa.array(padded(np.ones(n, np.int64))), pa.array(padded(sums[:, 0].astype(np.int64))), pa.array(padded(sums[:, 1].astype(np.int64))), *(pa.array(padded(sums[:, x])) for x in (2, 3, 4))],
                    names=names,
                )

    # Rows alike in id and text are summed up as one and told apart again by their number.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(keyed.mapInArrow(split, f"doc_id {kind}, h long, word binary, times long, copies long, n_tokens long, n_known long, base double, score double, alone double"), "document-words")
    sums = ["copies", "n_tokens", "n_known", "base", "score", "alone"]
    rare = rows.filter(~edge).select("doc_id", "h", "word", "times").join(table.select("word", "c", F.col("base").alias("b"), F.col("score").alias("s"), F.col("alone").alias("a")), "word")
    rare = rare.select("doc_id", "h", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_known"), (F.col("times") * F.col("b")).alias("base"), (F.col("times") * F.col("s")).alias("score"), (F.col("times") * F.col("a")).alias("alone"))
    whole = rows.filter(edge).select("doc_id", "h", *sums).unionByName(rare).groupBy("doc_id", "h").agg(*(F.sum(c).alias(c) for c in sums))
    each = [(F.col(c) / F.col("copies")).alias(c) for c in sums[1:]]
    whole = whole.select("doc_id", *each, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return whole.select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        (F.round("n_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_scores[0])).alias("base_score"),
        (F.col("score") + F.lit(end_scores[1])).alias("score"),
        (F.col("alone") + F.lit(end_scores[2])).alias("lattice_score"),
    )


def scoring_report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    rows = score_documents(docs.select("doc_id", "text", (~held_out("doc_id", 7, 2)).alias("train")), "train")
    return rows.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
