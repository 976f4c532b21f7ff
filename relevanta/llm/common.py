"""What several operators share: staging in the shared folder, the hold-out rule, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.sources.work import staged, work_path as new_path  # noqa: F401

#: One token of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Caches of a Python worker process that outlive a task, so that later tasks of the stage find them filled.
CACHES: list = []


def free_caches() -> None:
    """Drops them, and gives back to the system what the worker has freed. Spark hands workers on from stage to stage; one
    that has no use for the caches, or for the batches of an earlier stage, leaves that memory to others."""
    if any(cache.cache_info().currsize for cache in CACHES):
        for cache in CACHES:
            cache.cache_clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Returns what the worker has freed to the system; caches stay."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    """The C library's call that returns freed memory, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


_TRIM = _trimmer()


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """True where crc32(id as text) mod ``mod`` is ``rest``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod) == rest


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def list_array(values: np.ndarray, lengths: np.ndarray, type_: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type_))


def chunks(texts: list, most_chars: int) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of consecutive texts with about ``most_chars`` characters each, one text at least."""
    i = n = 0
    for j, text in enumerate(texts):
        n += len(text)
        if n >= most_chars:
            yield i, j + 1
            i, n = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def sampled(rows: DataFrame, class_col: str, keys: list[str], each: int, seed: int) -> DataFrame:
    """``rows`` with ``_h``, a hash of ``keys``, those whose hash is below a bound that keeps about ``2 * each`` different
    ones of every class, or all of a small class. ``first_of_each`` then takes ``each`` of them exactly.

    The different hashes of each class are counted first by a sketch (one row a class reaches the driver), so rows that
    repeat neither crowd out others nor come in numbers: no task sorts or hands on more than its share.
    """
    rows = rows.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    counts = {r["c"]: r["n"] for r in rows.groupBy(F.col(class_col).alias("c")).agg(F.approx_count_distinct("_h").alias("n")).collect() if r["c"] is not None}
    bounds = [F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 2.0 * each / max(n, 1)))]
    if not bounds:
        return rows.limit(0)
    u = F.col("_h").cast("double") / F.lit(2.0**64) + 0.5
    return rows.filter(u <= F.try_element_at(F.create_map(*bounds), F.col(class_col)))


def first_of_each(rows: DataFrame, class_col: str, each: int) -> DataFrame:
    """Of what ``sampled`` gave the ``each`` rows of every class with the smallest different hashes, with their ``_rank``
    from 1. Other columns than the class are those of any of the rows with that hash."""
    rows = rows.dropDuplicates([class_col, "_h"])
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(class_col).orderBy("_h"))).filter(F.col("_rank") <= each)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns (integers without nulls), over the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(keys)], 1)
        if held and (own[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        bounds = np.r_[0, np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1, len(own)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(own):
                yield pa.Table.from_batches(held)
                held = []
        last = own[-1]
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, no run of equal values in the first column (integers without nulls) cut by the end of a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = np.asarray(batch.column(0))
        cut = int(np.searchsorted(key == key[-1], True))  # rows are sorted: the last run starts here
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, key_col: str, size_col: str, node_col: str, block: int) -> DataFrame:
    """``rows`` in groups ``(key_col, _i, _j)`` of two blocks, of at most about ``2 * block`` rows: any two rows of a key meet in some group."""
    blocks = F.ceil(F.col(size_col) / block).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(node_col), F.col("_blocks")).cast("int"))
    # two blocks together hold the pairs within each of them
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: (x != F.col("_own")) | (F.col("_blocks") == 1))
    rows = rows.withColumn("_other", F.explode(others))
    return rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_own", "_other", "_blocks")
