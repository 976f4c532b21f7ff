"""Text files under names of their own, published together.

Tasks write each name's lines to a file in a hidden folder, under a name that no other attempt uses, and report it; the
reports are written by Spark's committed writer. Only then a second job moves the reported files to their names, each task
its own, so a run that fails before leaves no named file, and one that is repeated after a lost executor ends in the same
files. What attempts left behind goes with the hidden folder. Paths are those of any store that both Spark and
``pyarrow.fs`` open. A name may hold any characters; those a file's name can't are percent-encoded.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.sources.work import staged

_SAFE = " !#$&'()+,;=@[]^_`{}~"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def file_name(name: str, suffix: str) -> str:
    return (quote(name, safe=_SAFE) or "%00") + suffix


def write_named_files(rows: DataFrame, path: str, name_col: str, line_col: str, order: list, suffix: str = ".txt") -> DataFrame:
    """One file a value of ``name_col`` below ``path`` with its lines in an order; a null name or line is left out. Returns
    ``name, file, lines``. A file is one task's, which streams it; an existing file of the name is replaced."""
    hidden = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    lines = rows.filter(F.col(name_col).isNotNull() & F.col(line_col).isNotNull())
    lines = lines.withColumns({"_name": F.col(name_col).cast("string"), "_line": F.col(line_col).cast("string")})
    ordered = lines.repartition("_name").sortWithinPartitions("_name", *order).select("_name", "_line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = open_store(hidden)
        store.create_dir(where, recursive=True)
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for name, own in itertools.groupby(pairs, key=lambda pair: pair[0]):
            part, count = f"{uuid.uuid4().hex}", 0
            with store.open_output_stream(f"{where}/{part}", compression=None, buffer_size=1 << 20) as out:
                for _, line in own:
                    out.write(f"{line}\n".encode())
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([count], pa.int64())], names=["name", "part", "lines"])

    done = staged(ordered.mapInArrow(write, "name string, part string, lines long"), "named-files")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, target), (_, source) = open_store(path), open_store(hidden)
        for batch in batches:
            files = []
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.append(file_name(name, suffix))
                here = store.get_file_info(f"{source}/{part}").type
                if here != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(f"{source}/{part}", f"{target}/{files[-1]}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string()), batch.column(2)], names=["name", "file", "lines"])

    out = staged(done.mapInArrow(publish, "name string, file string, lines long"), "named-files")
    store, source = open_store(hidden)
    if store.get_file_info(source).type != fs.FileType.NotFound:
        store.delete_dir(source)
    return out
