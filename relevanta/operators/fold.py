"""Aggregates of a user's own: a start, a step and a merge, in Python, over states that no built-in aggregate has.

Each task folds its own rows, so a key sends at most one state a task to the shuffle (more only where a task meets more keys
than it may hold). Partial states travel as bytes and are merged in two rounds, first by key and one of ``fan`` lots, then by
key: a hot key's states meet in ``fan`` tasks before its last few meet in one. The merge must not depend on order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def user_aggregate(
    rows: DataFrame,
    keys: list[str],
    columns: list[str],
    start: Callable[[], Any],
    step: Callable[..., Any],
    merge: Callable[[Any, Any], Any],
    result: str,
    finish: Callable[[Any], tuple] = lambda state: state,
    fan: int = 32,
    most_keys: int = 50_000,
) -> DataFrame:
    """``keys`` and the columns of ``result`` (a schema in SQL): of each key ``finish(state)``, where a state begins as
    ``start()``, takes a row by ``step(state, *columns)`` and another state by ``merge(state, other)``; both return the new
    state. A null key is a key of its own; a table without rows gives none. States must be picklable and fit into memory,
    ``most_keys`` of them in a task."""
    key_types = StructType([rows.schema[k] for k in keys])
    partial = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in key_types)}, _state binary"
    key_arrow = to_arrow_schema(key_types)

    def given(states: dict) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in states], f.type) for i, f in enumerate(key_arrow)]
        packed = pa.array([pickle.dumps(s, pickle.HIGHEST_PROTOCOL) for s in states.values()], pa.binary())
        states.clear()
        return pa.RecordBatch.from_arrays([*arrays, packed], names=[*keys, "_state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            for key, values in zip(zip(*own[: len(keys)], strict=True), zip(*own[len(keys) :], strict=True), strict=True):
                states[key] = step(states[key] if key in states else start(), *values)
                if len(states) > most_keys:
                    yield given(states)
        yield given(states)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Any]]:
        """Each run of equal keys as its merged state."""
        last, state = None, None
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            for *key, packed in zip(*own, strict=True):
                other = pickle.loads(packed)
                if last == key:
                    state = merge(state, other)
                else:
                    if last is not None:
                        yield tuple(last), state
                    last, state = key, other
        if last is not None:
            yield tuple(last), state

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for key, state in runs(batches):
            states[key] = state
            if len(states) >= 1000:
                yield given(states)
        yield given(states)

    out_types = StructType.fromDDL(result)
    out_arrow = to_arrow_schema(StructType([*key_types, *out_types]))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        for key, state in runs(batches):
            done.append((*key, *finish(state)))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out_arrow, strict=True)], schema=out_arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out_arrow, strict=True)], schema=out_arrow)

    states = rows.select(*keys, *columns).mapInArrow(fold, partial)
    lots = states.withColumn("_lot", F.pmod(F.xxhash64("_state"), F.lit(fan)))
    lots = lots.repartition(*keys, "_lot").sortWithinPartitions(*keys, "_lot").select(*keys, "_state").mapInArrow(merged, partial)
    lots = lots.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "_state")
    return lots.mapInArrow(finished, StructType([*key_types, *out_types]))


class Spans:
    """Unions of closed intervals of whole numbers, kept apart and in order: a state for ``user_aggregate``."""

    @staticmethod
    def start() -> list:
        return []

    @staticmethod
    def step(state: list, low: int | None, high: int | None) -> list:
        return state if low is None or high is None or high < low else Spans.merge(state, [(low, high)])

    @staticmethod
    def merge(a: list, b: list) -> list:
        out: list = []
        for low, high in sorted([*a, *b]):
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], high))
            else:
                out.append((low, high))
        return out

    @staticmethod
    def finish(state: list) -> tuple:
        """How many intervals, how many numbers they hold, and the longest gap between two."""
        gaps = [b[0] - a[1] - 1 for a, b in zip(state, state[1:], strict=False)]
        return len(state), sum(high - low + 1 for low, high in state), max(gaps, default=0)
