"""WARC archives of pages with a two-level capture index.

Records are WARC/1.1, each a gzip member of its own, so that any of them is read by one range read. Of pages with equal
payloads of at least ``least`` bytes the one with the smallest id is a response, the others are revisits that refer to it.

The index is sorted by url keys with the host reversed (``com,example)/path``). Shards of a range of keys are files of
compressed blocks of ``BLOCK_LINES`` lines; the directory keeps for each block its keys' ends and its place in the file. A
lookup finds its shards by binary search among their ends, then its blocks by binary search in the shard's directory, and
range-reads those. A key may fill many blocks and shards.

Tasks write files under names of their own and return their places; the table of places is written by Spark's committed
Parquet writer, and readers open what it names. Files of lost attempts are never read. Paths are those of any store that
both Spark and ``pyarrow.fs`` open.

Defined results: null html is empty; null and unreadable urls are kept as they are under a key of their own text; a null
page id counts as the largest; rows alike in id and payload are several records, one of them the response; an empty table
gives no records; other columns are ignored. Ties are settled by the place of a row in its table, so pages should come from
files. A task holds one batch of pages, and in lookups a shard's directory (a 3,000th of its lines) and a block.
"""

from __future__ import annotations

import bisect
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevanta.llm.common import new_path, staged

#: Payloads that are shorter are all stored.
LEAST = 100
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
#: Records of one stretch of a file are read by one task.
STRETCH = 64 << 20
#: Shards' ends are compared by so many characters among the broadcast ones.
CUT = 256
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTED = "".join(map(chr, range(33, 127)))


def url_key(url: Column) -> Column:
    """Reversed host, port if it isn't 80 or 443, and path with query; a text that is no such url is its own key."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^#]*)"
    place, rest = F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2)
    host = F.lower(F.regexp_extract(place, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    turned = F.when(host.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$"), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    key = F.concat(turned, F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(whole.rlike(pattern), key).otherwise(whole)


def record_plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, key, html, digest, bytes, revisits, shared, of_page``: each page and, if its payload is stored for another, for
    which. Payloads meet by digest; payloads that are there twice at least are looked for first, without texts, so that
    only their own pages are joined. Rows that repeat as a whole are counted there: one is stored, the rest are made from
    the count."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    counted = rows.filter(F.col("bytes") >= least).groupBy("digest", "page_id", "url", "bytes").agg(F.count("*").alias("n"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url", "n")
    groups = counted.groupBy("digest", "bytes").agg(F.min(place).alias("first"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    groups = staged(groups.select("digest", "bytes", F.col("first.page_id").alias("of_page"), F.col("first.url").alias("of_url"), F.col("first.n").alias("n")), "repeated-payloads")
    # texts too short to be shared meet nothing and are dealt out by their ids
    same = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("_same", same).join(groups.select(F.col("digest").alias("_same"), "of_page", "of_url", "n"), "_same", "left")
    first = F.col("of_page").eqNullSafe(F.col("page_id")) & F.col("of_url").eqNullSafe(F.col("url"))
    revisits = F.col("n").isNotNull() & ~first
    columns = ["page_id", "url", url_key(F.col("url")).alias("key"), "html", "digest", "bytes", "revisits", "shared", "of_page"]
    out = joined.filter(F.col("n").isNull() | ~first | (F.col("n") == 1)).withColumns({"revisits": revisits, "shared": F.col("n").isNotNull(), "html": F.when(~revisits, F.col("html"))}).select(*columns)
    repeated = groups.filter("n > 1")
    if repeated.isEmpty():
        return out
    stored = joined.filter(first & (F.col("n") > 1)).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html", "bytes", "of_page"))).withColumns({"revisits": F.lit(False), "shared": F.lit(True)})
    rest = repeated.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))).alias("_from")).repartition("digest", "_from")
    rest = rest.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + 999, F.col("n") - 1))))
    rest = rest.select(F.col("of_page").alias("page_id"), F.col("of_url").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "bytes", F.lit(True).alias("revisits"), F.lit(True).alias("shared"), "of_page")
    return out.unionByName(stored.select(*columns)).unionByName(rest.select(*columns))


def _store(path: str):
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def payload_id(digest: str) -> str:
    """The id of the record that stores a payload others refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'sha256:{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*headers, ("Content-Length", str(len(block)))))
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packed.flush()


def page_record(row: dict, date: str = DATE, level: int = 6) -> bytes:
    """The record of a row of ``record_plan``."""
    own = row["revisits"] or not row["shared"]
    uri = [] if row["url"] is None else [("WARC-Target-URI", quote(row["url"], safe=_PRINTED, errors="surrogatepass"))]
    headers = [("WARC-Type", "revisit" if row["revisits"] else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if own else payload_id(row["digest"])), ("WARC-Date", date), *uri, ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["page_id"] is not None:
        headers.append(("X-Page-Id", str(row["page_id"])))
    if row["revisits"]:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", payload_id(row["digest"]))]
        headers += [("X-Refers-To-Page-Id", str(row["of_page"]))] if row["of_page"] is not None else []
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    return _member(headers, http if row["revisits"] else http + row["html"].encode(), level)


def parse_record(member: bytes) -> dict:
    """A record's WARC headers, HTTP headers (names in lower case) and payload; a revisit has none."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = lambda x: {k.lower(): v for k, v in (line.split(": ", 1) for line in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if not head.startswith(b"WARC/1.1\r\n") or len(block) + 4 != len(rest):
        raise ValueError("not one record")
    http, payload = {}, None
    if warc["warc-type"] in ("response", "revisit"):
        top, body = block.split(b"\r\n\r\n", 1)
        http, payload = fields(top), body if warc["warc-type"] == "response" else None
    return {"warc": warc, "http": http, "payload": payload}


class _File:
    """A new file in a folder, named as no other attempt names its own."""

    def __init__(self, path: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        store, where = _store(path)
        store.create_dir(where, recursive=True)
        self.stream, self.size = store.open_output_stream(f"{where}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> int:
        """Where the data begin."""
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)


def write_archives(plan: DataFrame, path: str, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes the records of ``record_plan``, one file or more a partition; returns their captures
    ``key, file, offset, length``, themselves written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            found = []
            for row in (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                if out is None or out.size >= FILE_BYTES:
                    if out is not None:
                        out.stream.close()
                    out = _File(path, ".warc.gz")
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                member = page_record(row, date, level)
                found.append((row["key"], out.name, out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.stream.close()

    return staged(plan.mapInArrow(run, "key string, file string, offset long, length long"), "captures")


def write_capture_index(captures: DataFrame, path: str, shards: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the captures sorted by key, in compressed blocks; returns the directory
    ``shard, offset, length, first_key, last_key``, itself written."""
    order = ["key", "file", "offset"]
    ordered = captures.select("key", "file", "offset", "length")
    ordered = (ordered.repartitionByRange(shards, *order) if shards else ordered.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, ends, found = None, [], [], []

        def cut() -> None:
            packed = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packed.compress("".join(lines).encode("utf-8", "surrogatepass")) + packed.flush()
            found.append((out.name, out.write(data), len(data), ends[0], ends[-1]))
            lines.clear()
            ends.clear()

        def give() -> pa.RecordBatch:
            rows = list(zip(*found, strict=True)) or [[]] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["shard", "offset", "length", "first_key", "last_key"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _File(path, ".idx.gz")
                lines.append(json.dumps(row) + "\n")
                ends.append(row[0])
                if len(lines) == block_lines:
                    cut()
            yield give()
        if lines:
            cut()
            yield give()
        if out is not None:
            out.stream.close()

    return staged(ordered.mapInArrow(run, "shard string, offset long, length long, first_key string, last_key string"), "directory")


def lookup(keys: DataFrame, directory: DataFrame, path: str) -> DataFrame:
    """``key, file, offset, length``: the captures of each different key of ``keys(key)``."""
    spark = keys.sparkSession
    # one row a shard, its ends cut to CUT characters: shards are at most the partitions of the job that wrote them
    tops = directory.groupBy("shard").agg(F.min(F.left("first_key", F.lit(CUT))).alias("first"), F.max(F.left("last_key", F.lit(CUT))).alias("last"))
    tops = sorted((r["first"], r["last"], r["shard"]) for r in tops.collect())
    known = spark.sparkContext.broadcast(([t[0] for t in tops], [t[1] for t in tops], [t[2] for t in tops]))

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = known.value
        for batch in batches:
            out = [(names[i], k) for k in batch.column(0).to_pylist() for i in range(bisect.bisect_left(lasts, k[:CUT]), bisect.bisect_right(firsts, k[:CUT]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["shard", "key"])

    asked = keys.filter("key is not null").select("key").distinct().mapInArrow(shards_of, "shard string, key string")
    none = F.lit(None)
    blocks = directory.select("shard", F.lit(0).alias("_k"), F.col("first_key").alias("key"), "last_key", "offset", "length")
    rows = blocks.unionByName(asked.select("shard", F.lit(1).alias("_k"), "key", none.cast("string").alias("last_key"), none.cast("long").alias("offset"), none.cast("long").alias("length")))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "_k", F.coalesce("offset", F.lit(0)), "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(path)
        shard, stream, firsts, lasts, places, held, lines = None, None, [], [], [], None, []
        for batch in batches:
            found = []
            for name, kind, key, last, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    if stream is not None:
                        stream.close()
                    shard, stream, firsts, lasts, places, held = name, None, [], [], [], None
                if kind == 0:
                    firsts.append(key)
                    lasts.append(last)
                    places.append((offset, length))
                    continue
                for block in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    if block != held:
                        stream = stream or store.open_input_file(f"{where}/{shard}")
                        raw = stream.read_at(places[block][1], places[block][0])
                        lines, held = [json.loads(x) for x in zlib.decompress(raw, 31).decode("utf-8", "surrogatepass").splitlines()], block
                    at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while at < len(lines) and lines[at][0] == key:
                        found.append(lines[at])
                        at += 1
                    if len(found) >= 20_000:
                        yield _captures(found)
                        found = []
            yield _captures(found)
        if stream is not None:
            stream.close()

    return rows.mapInArrow(search, "key string, file string, offset long, length long")


def _captures(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])


def read_records(captures: DataFrame, path: str) -> DataFrame:
    """``file, offset, warc MAP, http MAP, payload BINARY`` of captures, by range reads in the order of the files."""
    dealt = captures.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    text_map = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(path)
        name, stream, found, size = None, None, [], 0

        def give() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), text_map, text_map, pa.binary()), strict=True)], names=["file", "offset", "warc", "http", "payload"])

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, store.open_input_file(f"{where}/{file}")
                record = parse_record(stream.read_at(length, offset))
                found.append((file, offset, list(record["warc"].items()), list(record["http"].items()), record["payload"]))
                size += len(record["payload"] or b"")
                if size >= 8 << 20 or len(found) >= 2000:
                    yield give()
                    size = 0
        if stream is not None:
            stream.close()
        yield give()

    return dealt.mapInArrow(run, "file string, offset long, warc map<string,string>, http map<string,string>, payload binary")


def archive_report(pages: DataFrame) -> DataFrame:
    """The contract's rows: the pages are written and indexed, every page's key is looked up, its records are read."""
    path = new_path(pages.sparkSession, "archive")
    captures = write_archives(record_plan(pages), f"{path}/warc")
    directory = write_capture_index(captures, f"{path}/index")
    found = lookup(pages.select(url_key(F.col("url")).alias("key")), directory, f"{path}/index")
    records = read_records(found, f"{path}/warc")
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return records.select(
        at("warc", "x-page-id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), at("http", "content-length").cast("long")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substr(at("warc", "warc-payload-digest"), F.lit(len("sha256:") + 1))).alias("payload_digest"),
        at("warc", "warc-type").alias("record_type"),
        at("warc", "x-refers-to-page-id").cast("long").alias("refers_to"),
    )
