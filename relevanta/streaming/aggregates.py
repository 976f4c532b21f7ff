"""Metric rows that keep arriving: one running aggregate a tag, setting and metric.

Senders deliver a row again when they are unsure; a row is known by its sender and sequence number. ``without_replays`` keeps
those of a time window as state, which expires with the watermark. The state lies on the executors' disks, with one bounded
cache an executor. Each trigger passes over all of it to find what has expired, so a backlog is taken in a number of triggers
that doesn't grow with it (``files_per_trigger``). Aggregates are no state: each trigger writes the partial
aggregates of its own rows, partial aggregates merge, and from time to time all of them are merged into a snapshot, behind
which older files go.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from relevanta.operators.aggregate import KEYS, aggregate_metrics, merge_aggregates


#: Where streams keep their state, unless the session sets these itself.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def files_per_trigger(files: int, least: int = 4, triggers: int = 6) -> int:
    """How many files a trigger takes so that a backlog of ``files`` is done in about ``triggers``, ``least`` at a time."""
    return max(least, -(-files // triggers))


def read_metric_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Metric rows as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_replays(rows: DataFrame, sender_col: str = "sender", seq_col: str = "seq", time_col: str = "sent_at", delay: str = "1 day") -> DataFrame:
    """Each sender's sequence number once. A row sent again within ``delay`` of event time is dropped by its number, one that
    is older than the watermark as late; so numbers are kept for ``delay`` and no longer."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([sender_col, seq_col])


def by_tag(rows: DataFrame, tags_col: str = "tags") -> DataFrame:
    """A row for each of its tags."""
    return rows.withColumn("tag", F.explode(tags_col)).drop(tags_col)


def stream_aggregate_metrics(rows: DataFrame, tags_col: str | None = "tags", keys: list[str] = KEYS) -> DataFrame:
    """The batch aggregate over a stream, for sinks that take updates; a row with several tags counts in each, failures are
    counted too. Its groups are the stream's state."""
    return aggregate_metrics(by_tag(rows, tags_col) if tags_col else rows, keys)


def write_partials(rows: DataFrame, path: str, checkpoint: str, keys: list[str] = KEYS, snapshot_every: int = 20) -> StreamingQuery:
    """Writes the partial aggregates of each trigger's rows under its batch number, so that a batch done twice is one result.
    Every ``snapshot_every`` batches all are merged into a snapshot. What lies behind the snapshot before is deleted then:
    the folder holds two snapshots and the batches of two rounds at most, and a reader has a round's time to finish."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        aggregate_metrics(batch, keys).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % snapshot_every == 0:
            _merged(spark, path, keys, number).write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")
            older = [n for n in _batches(spark, f"{path}/snapshots") if n < number]
            for kind in ("changes", "snapshots"):
                for n in _batches(spark, f"{path}/{kind}"):
                    if older and (n <= older[-1] if kind == "changes" else n < older[-1]):
                        folder, store = _hadoop(spark, f"{path}/{kind}/batch={n}")
                        store.delete(folder, True)

    return _start(rows.sparkSession, rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(keep))


def _start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a stream with ``STATE``, which a query takes from its session when it starts."""
    unset = [name for name in STATE if spark.conf.get(name, None) is None]
    try:
        for name in unset:
            spark.conf.set(name, STATE[name])
        return writer.start()
    finally:
        for name in unset:
            spark.conf.unset(name)


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are written completely, ascending."""
    folder, store = _hadoop(spark, path)
    if not store.exists(folder):
        return []
    done = [f.getPath() for f in store.listStatus(folder) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(m[1]) for p in done if (m := re.fullmatch(r"batch=(\d+)", p.getName())))


def _merged(spark: SparkSession, path: str, keys: list[str], up_to: int | None = None) -> DataFrame:
    inside = lambda n: up_to is None or n <= up_to
    snapshots = [n for n in _batches(spark, f"{path}/snapshots") if up_to is None or n < up_to]
    since = snapshots[-1] if snapshots else -1
    paths = [f"{path}/snapshots/batch={since}"] * bool(snapshots) + [f"{path}/changes/batch={n}" for n in _batches(spark, f"{path}/changes") if n > since and inside(n)]
    return merge_aggregates(spark.read.parquet(*paths), keys)


def merged(spark: SparkSession, path: str, keys: list[str] = KEYS) -> DataFrame:
    """The aggregates over all rows that ``write_partials`` has taken."""
    return _merged(spark, path, keys)


def write_running(aggregates: DataFrame, path: str, checkpoint: str, keys: list[str] = KEYS, snapshot_every: int = 20) -> StreamingQuery:
    """Keeps the changed aggregates of each trigger under its batch number, so that a batch done twice is one result.
    Every ``snapshot_every`` batches the newest aggregate of each group is written as a snapshot: readers need the last one
    and the batches after it. The folder keeps them all: ``write_partials`` is for streams that don't end."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % snapshot_every == 0:
            latest(batch.sparkSession, path, keys, number).write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")

    return _start(aggregates.sparkSession, aggregates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep))


def latest(spark: SparkSession, path: str, keys: list[str] = KEYS, up_to: int | None = None) -> DataFrame:
    """The newest aggregate of each group that ``write_running`` has kept (before or in batch ``up_to``)."""
    rows = spark.read.parquet(f"{path}/changes")
    if up_to is not None:
        rows = rows.filter(F.col("batch") <= up_to)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        snapshots = spark.read.parquet(f"{path}/snapshots")
        # a snapshot is used once the batch after it has begun: until then it may be half written
        last = rows.agg(F.max("batch")).first()[0] if up_to is None else up_to
        newest = snapshots.filter(F.col("batch") < last).agg(F.max("batch")).first()[0]
        if newest is not None:
            rows = rows.filter(F.col("batch") > newest).unionByName(snapshots.filter(F.col("batch") == newest))
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_x")).select(*keys, "_x.*")
