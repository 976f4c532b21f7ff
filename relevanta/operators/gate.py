"""Batches that end early: a job counts its failures while it runs and is cancelled once they are too many."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_while_good(rows: DataFrame, failed: Column, path: str, most: float, total: int, poll: float = 0.05) -> dict:
    """Writes ``rows`` as Parquet unless more than the fraction ``most`` of ``total`` rows has failed.

    Every task counts as it goes and reports at its end; once the reported failures exceed ``most * total`` the job's tag is
    cancelled, so tasks that haven't begun never do, and nothing is published. Returns ``stopped``, and the ``rows`` and
    ``fails`` reported until then. A job that fails for another reason raises.
    """
    context = rows.sparkSession.sparkContext
    seen, fails = context.accumulator(0), context.accumulator(0)
    marked = rows.withColumn("_failed", F.coalesce(failed, F.lit(False)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bad = 0
        for batch in batches:
            n += batch.num_rows
            bad += batch.column(batch.num_columns - 1).true_count
            yield batch.select(batch.schema.names[:-1])
        seen.add(n)
        fails.add(bad)

    tag, result = f"gate-{uuid.uuid4().hex}", {}

    def work() -> None:
        context.addJobTag(tag)
        try:
            marked.mapInArrow(counted, rows.schema).write.parquet(path)
        except Exception as error:  # handed to the caller below
            result["error"] = error
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=work)
    thread.start()
    stopped = False
    while thread.is_alive():
        thread.join(poll)
        if not stopped and fails.value > most * total:
            stopped = True
            context.cancelJobsWithTag(tag)
    # a job may end before the last look
    late = fails.value > most * total
    if "error" in result and not stopped:
        raise result["error"]
    if late and "error" not in result:
        _remove(rows, path)
    return {"stopped": stopped or late, "rows": seen.value, "fails": fails.value}


def _remove(rows: DataFrame, path: str) -> None:
    target = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
