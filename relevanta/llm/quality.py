"""Quality classifier by compression.

A Zstandard dictionary is trained on good and one on bad labelled text. A text is cut into blocks, so that the dictionary
matters throughout, and each block is compressed with either dictionary. The normalised difference of the two compressed
sizes of the whole text, and the two sizes over the text's own, are turned into a probability by logistic regression on
labelled rows that the dictionaries have not seen.

The model is fitted from a bounded sample of labelled rows, ``sample_docs`` a label, by hash of id and text: for the
dictionaries ``sample_blocks`` blocks from all over each text reach the driver, for the regression only the features of
whole texts. Scoring is row by row over whole texts.

Defined results: null and empty texts are scored like any text, as one empty block; a null id counts as the empty text
in the hold-out rule and has no label; a document labelled twice alike counts once, one labelled both 0 and 1 teaches
nothing, nor does any other label; without labels of both kinds every score is the share of good labels (0.5 without any);
an empty table gives no rows; other columns are passed on by ``add_quality``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.llm.common import first_of_each, free_caches, held_out, sampled, staged

BLOCK = 256
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the standardised features, then the constant
    mean: tuple[float, ...]
    spread: tuple[float, ...]


def _blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


@functools.lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return tuple(zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(d)).compress for d in (good, bad))


def features(text: str, good: bytes, bad: bytes) -> list[float]:
    """Compressed size of the whole text under ``good`` less that under ``bad``, over the larger of both; then each over
    the text's own size. None of them drifts with the length of the text."""
    if not good or not bad:
        return [0.0, 0.0, 0.0]
    blocks = _blocks(text.encode())
    size = sum(map(len, blocks)) + len(blocks)
    g, b = (sum(len(c(x)) for x in blocks) for c in _compressors(good, bad))
    return [(g - b) / max(g, b), g / size, b / size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = ridge * len(y) * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
    return tuple(w.tolist()), tuple(mean.tolist()), tuple(spread.tolist())


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to select from: all of it is the dictionary
        return b"".join(samples)[-size:]


def _spread_blocks(most: int):
    @F.pandas_udf("array<binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            blocks = [_blocks((t or "").encode()) for t in texts]
            yield pd.Series([[b[i] for i in np.unique(np.linspace(0, len(b) - 1, min(most, len(b))).astype(int)) if len(b[i]) > 8] for b in blocks])

    return run


def _features(good: bytes, bad: bytes):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "", good, bad) for t in texts], dtype=object)

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000, sample_blocks: int = 16, dictionary_bytes: int = 65_536, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Model from documents and their labels 0 or 1. A third of the sample makes the dictionaries, the rest the weights.

    The sample is drawn from ids and labels alone; its ids, ``2 * sample_docs`` at most, are broadcast to find its texts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most").drop("_most")
    ids = docs.select(F.col(id_col).alias("_id")).join(known, "_id").select("_id", "_label")
    drawn = first_of_each(sampled(ids, "_label", ["_id"], sample_docs, 9), "_label", sample_docs).select("_id", "_label")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    # an id may have many rows
    rows = staged(first_of_each(sampled(rows, "_label", ["_id", "text"], sample_docs, 9), "_label", sample_docs).select("_label", "_rank", "text"), "quality-sample")
    count = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    first, rest = rows.filter("_rank % 3 = 1"), rows.filter("_rank % 3 <> 1")
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in first.select("_label", "_rank", _spread_blocks(sample_blocks)("text").alias("blocks")).orderBy("_label", "_rank").collect():
        samples[r["_label"]] += map(bytes, r["blocks"])
    if not all(count.get(k, 0) > 1 and samples[k] for k in (0, 1)):
        n, ones = sum(count.values()), count.get(1, 0)
        share = (ones / n) if n else 0.5
        return QualityModel(b"", b"", (0.0,) * 3 + (float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)),), (0.0,) * 3, (1.0,) * 3)
    good, bad = (_dictionary(samples[k], dictionary_bytes) for k in (1, 0))
    seen = rest.select("_label", "_rank", _features(good, bad)("text").alias("x")).orderBy("_label", "_rank").collect()
    return QualityModel(good, bad, *_logistic(np.array([r["x"] for r in seen]), np.array([r["_label"] for r in seen], float)))


def add_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1, higher where label 1 is likelier. A column of that name is replaced."""
    weights, mean, spread = np.array(model.weights), np.array(model.mean), np.array(model.spread)
    good, bad = model.good, model.bad

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        free_caches()
        for texts in batches:
            x = np.array([features(t or "", good, bad) for t in texts]).reshape(-1, len(mean))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / spread, np.ones(len(x))] @ weights, -500, 500))))

    return docs.withColumn(score_col, score(F.col(text_col)))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the hold-out."""
    return labels.filter(~held_out("doc_id", 3, 1)).select("doc_id", "quality")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = add_quality(docs.select("doc_id", "text"), fit(docs, training_labels(labels)))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
