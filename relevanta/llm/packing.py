"""Packing by minimum bin slack.

Documents are cut into full windows and one remainder each. Only the number of remainders of each length matters for
the choice, so the choice is made once from at most ``window`` counts: the longest remainder left opens a sequence, a
subset-sum over the counts (bitset, backtracked) fills it as close to the window as any multiset can, and the pattern is
repeated as often as the counts allow. Each pattern uses up a length, so there are few patterns whatever the input.
Pieces then find their sequence from their rank among the pieces of their length, which prefix sums over partitions give.

Defined results: a null text is empty and holds the end id alone; null ids and repeated rows are packed like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevanta.llm.common import chunks, free_caches, give_back, list_array, staged, texts_of
from relevanta.llm.token_files import ids_digest
from relevanta.llm.tokens import CACHE_ENTRIES, default_tokenizer, encoder


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is the largest not above ``room``."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, left, times = reach, min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time
            take = min(times, left)
            reach |= (reach << (length * take)) & full
            left, times = left - take, times * 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> total & 1:
            total, copies = total - length, copies + 1
        if copies:
            used[length] = copies
    return used


def patterns(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """``(number of sequences, {length: copies in each})`` that use up the histogram."""
    left, out = {x: n for x, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = closest_fill(left, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((times, used))
    return out


def _lookup(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies a sequence, offset of the first copy), sorted."""
    rows, ranks, sequence = [], {}, 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, ranks.get(length, 0), sequence, used[length], offset))
            ranks[length] = ranks.get(length, 0) + used[length] * times
            offset += used[length] * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces ``(part, rank, doc_id, start, length, doc_tokens, ids)``; ``rank`` counts earlier pieces of the same length in the partition."""
    path = tokenizer or default_tokenizer()
    schema = f"part int, rank long, {id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, doc_tokens long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end, codec = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), np.int32(end_id).tobytes(), encoder(path, cache_entries)
        # a thousand texts at a time as Python strings; what the last ones have freed goes back to the system
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            give_back()
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts, 4_000_000):
                rows = codec.encode(texts[i:j])
                tokens = np.array([len(r) // 4 + 1 for r in rows], np.int64)
                pieces = -(-tokens // window)
                owner = np.repeat(np.arange(j - i), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(tokens[owner] - start, window)
                order = np.argsort(length, kind="stable")
                runs = length[order]
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.searchsorted(runs, runs) + seen[runs]
                seen += np.bincount(length, minlength=window + 1)
                ids = list_array(np.frombuffer(end.join(rows) + end, np.int32), length, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), part, np.int32)), pa.array(rank), batch.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(tokens[owner]), ids], names=["part", "rank", id_col, "start", "length", "doc_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def place(pieces: DataFrame, counts: DataFrame, window: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``part, length, rank``.

    ``counts`` has the number of pieces of each ``(part, length)``. At most ``window`` totals reach the driver.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _lookup(patterns(histogram, window))
    key = (table[:, 0] << 40) + table[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = pieces.join(bases, ["part", "length"])
    columns = [c for c in pieces.columns if c not in ("part", "rank")]
    joined = joined.select(*columns, (F.col("_base") + F.col("rank")).alias("_rank"))
    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    at = columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()  # the encoder's
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (at, len(columns)))
            row = table[np.searchsorted(key, (length << 40) + rank, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            past = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)], names=[*columns, "sequence_id", "offset"])

    return joined.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ``ids``, ``sequence_id`` and ``offset``."""
    pieces = staged(cut_documents(docs, window, end_id, tokenizer, id_col, text_col), "pieces")
    return place(pieces, pieces.groupBy("part", "length").agg(F.count("*").alias("n")), window)


def packing_report(docs: DataFrame, window: int = 2048, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """The contract's rows: the same placement, with each piece's ids reduced to their digest before the shuffle."""
    pieces = staged(cut_documents(docs, window, cache_entries=cache_entries), "pieces")
    digests = ids_digest(pieces, ["part", "rank", "doc_id", "start", "length", "doc_tokens"]).drop("n_ids")
    placed = place(digests, pieces.groupBy("part", "length").agg(F.count("*").alias("n")), window)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
