"""Token ids in ORC files: integer run lengths, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id, encoded in id order and written one file per partition, so that readers take
stripes in parallel and prune stripes and row groups by the min/max of ``doc_id`` or its Bloom filter.

Defined results: a null text is empty and gives the end id alone; a null id sorts first; rows with equal ids are all
kept, ordered by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevanta.llm.common import chunks, free_caches, list_array, new_path, texts_of
from relevanta.llm.tokens import default_tokenizer, encoder


def encode_documents(docs: DataFrame, end_id: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, local_start, doc_id, n_tokens, ids)`` for the rows as they are partitioned and ordered.

    ``part`` is the partition and ``local_start`` the number of ids before the document in it.
    """
    path = tokenizer or default_tokenizer()
    schema = f"part int, local_start long, {id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, end, codec = TaskContext.get().partitionId(), 0, np.int32(end_id).tobytes(), encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts, 4_000_000):
                rows = codec.encode(texts[i:j])
                lengths = np.array([len(r) // 4 + 1 for r in rows], np.int64)
                ids = list_array(np.frombuffer(end.join(rows) + end, np.int32), lengths, pa.int32())
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), pa.array(starts), batch.column(0).slice(i, j - i), pa.array(lengths), ids], names=["part", "local_start", id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", bloom_fpp: float = 0.01, stripe_bytes: int = 64 << 20, index_stride: int = 10_000) -> None:
    """Encode ``docs`` in ascending id order and write ORC files to ``path``."""
    # The hash and the row number only part rows of one id, so that a repeated id can't fill one task.
    order = [F.col(id_col).asc_nulls_first(), F.col("_h"), F.col("_n")]
    ordered = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_h"), F.monotonically_increasing_id().alias("_n")).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = encode_documents(ordered, end_id, tokenizer, id_col, text_col).write
    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": bloom_fpp, "orc.create.index": "true", "orc.row.index.stride": index_stride, "orc.stripe.size": stripe_bytes, "orc.compress": "ZSTD"}
    writer.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The files' rows; with ``doc_ids`` only those documents, by stripe statistics and Bloom filters."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.filter(F.col(id_col).isin(doc_ids))


def global_starts(tokens: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids in all rows before. One total per file is gathered, so its table is broadcast:
    a row of 12 bytes a file, at most as many as ``spark.sql.shuffle.partitions`` of the job that wrote them."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def ids_digest(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``n_ids`` and ``ids_crc32`` (unsigned, over little-endian unsigned 32-bit ids) of ``ids``."""
    fields = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()  # the encoder's, where its worker goes on with this
        for batch in batches:
            column = batch.column(len(keep))
            offsets = column.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), np.int32)).cast("B")
            digests = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(offsets) // 4, pa.int64()), pa.array(digests, pa.int64())], names=[*keep, "n_ids", "ids_crc32"])

    return tokens.select(*keep, "ids").mapInArrow(run, f"{fields}, n_ids long, ids_crc32 long")


def token_file_report(docs: DataFrame) -> DataFrame:
    """The contract's rows, from files written to and read back from the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path)
    rows = global_starts(read_token_files(spark, path).select("part", "local_start", "doc_id", "n_tokens", "ids"))
    return ids_digest(rows, ["doc_id", "start"]).withColumnRenamed("n_ids", "n_tokens")
