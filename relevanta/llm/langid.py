"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (1 to 3, blended, hashed) present in both over the root of the
product of their own numbers. A Nyström map through a few landmark texts of each language makes it a vector, and
one-versus-rest kernel ridge regression is fitted on a bounded sample of ``sample_docs`` documents a language, of which the
presence bits of whole texts (BUCKETS bits each) reach the driver. Any text is then scored by two matrix products, batch
by batch.

Defined results: a null text or one without a letter is ``und`` with score 0; a null id counts as the empty text in the
hold-out rule; the sample goes by hash of id and text, so rows without an id are sampled like others and rows that repeat
count once; rows without ``lang`` are not learned from; without any learned language all is ``und``; ties go to the
language that sorts first; an empty table gives no rows; other columns are passed on by ``add_language``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from relevanta.llm.common import chunks, first_of_each, free_caches, held_out, sampled

BUCKETS = 1 << 14
#: ASCII characters other than letters read as spaces.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
#: Texts whose presence vectors stand in memory at once.
ROWS = 128


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # buckets x landmarks, columns scaled to length 1
    weights: np.ndarray  # landmarks x languages, with the Nyström map folded in
    bias: np.ndarray


def bits(texts: list[str]) -> np.ndarray:
    """One row a text: which n-gram buckets occur."""
    raw = [b" " + t.lower().encode().translate(_PLAIN) + b" " for t in texts]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.array([len(r) for r in raw], np.int64)
    row, out = np.repeat(np.arange(len(raw)) * BUCKETS, sizes), np.zeros(len(raw) * BUCKETS, bool)
    ends = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes left in the text
    gram = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        gram = gram[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(18)
        own = ends[: len(gram)] >= n
        out[row[: len(gram)][own] + bucket[own]] = True
    return out.reshape(len(raw), BUCKETS)


def scaled(present: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = present.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def presence(texts: list[str]) -> np.ndarray:
    return scaled(bits(texts))


@F.pandas_udf(BinaryType())
def _packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Presence bits of each whole text, null where it has no letter."""
    for texts in batches:
        yield pd.Series([np.packbits(bits([t])[0]).tobytes() if has_letter(t) else None for t in texts], dtype=object)


def fit(docs: DataFrame, sample_docs: int = 400, landmarks: int = 96, ridge: float = 1e-2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model from rows with a text and a language; the sample of each language is its ``sample_docs`` smallest hashes."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = sampled(rows, "lang", ["_id", "text"], sample_docs, 6).select("lang", "_h", _packed(F.col("text")).alias("bits")).filter(F.col("bits").isNotNull())
    sample = sorted((r["lang"], r["_rank"], bytes(r["bits"])) for r in first_of_each(rows, "lang", sample_docs).collect())
    languages = tuple(sorted({k for k, _, _ in sample}))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    x = scaled(np.unpackbits(np.frombuffer(b"".join(b for _, _, b in sample), np.uint8).reshape(len(sample), -1), axis=1))
    y = np.array([[1.0 if k == lang else 0.0 for lang in languages] for k, _, _ in sample])
    each = max(1, landmarks // len(languages))
    chosen = [i for c in range(len(languages)) for i in np.flatnonzero(y[:, c])[:each]]
    z = x[chosen]
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ z.T).astype(float) @ to_map
    counts = y.sum(0)
    each_row = (y / counts).sum(1)[:, None]  # languages weigh the same
    mean_phi, mean_y = (each_row * phi).sum(0) / each_row.sum(), (each_row * y).sum(0) / each_row.sum()
    a, b = (phi - mean_phi) * np.sqrt(each_row), (y - mean_y) * np.sqrt(each_row)
    w = np.linalg.solve(a.T @ a + ridge * each_row.mean() * np.eye(a.shape[1]), a.T @ b)
    return LanguageModel(languages, np.ascontiguousarray(z.T), to_map @ w, mean_y - mean_phi @ w)


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    for i, j in chunks([texts[k] for k in known], 1_000_000):
        for s in range(i, j, ROWS):
            rows = known[s : min(s + ROWS, j)]
            margins = (presence([texts[k] for k in rows]) @ model.landmarks).astype(float) @ model.weights + model.bias
            best = margins.argmax(1)
            for k, c, m in zip(rows, best, margins[np.arange(len(rows)), best], strict=True):
                names[k], scores[k] = model.languages[c], min(1.0, max(0.0, m))
    return names, scores


def add_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", name_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. Columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x landmarks

    @F.pandas_udf("name string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        free_caches()
        for texts in batches:
            names, scores = predict([t if isinstance(t, str) else None for t in texts], shared.value)
            yield pd.DataFrame({"name": names, "score": scores})

    out = docs.withColumn("_language", run(F.col(text_col)))
    return out.withColumns({name_col: F.col("_language.name"), score_col: F.col("_language.score")}).drop("_language")


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.filter(~held_out("doc_id", 3, 1)))
    return add_language(rows.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
