import gzip
import hashlib
import random
from collections import Counter
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from relevanta.llm import warc

PAGES = "page_id long, url string, html string, key string, digest string, row long, file string"


def brute(rows) -> Counter:
    """The contract's rows; of rows alike in payload and smallest id any one is the response."""
    texts = {}
    for page_id, _, html, *_ in rows:
        texts.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in texts.items():
        raw = html.encode()
        first, *others = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(raw).hexdigest()
        out.append((first, len(raw), digest, "response", None))
        out += [(i, len(raw), digest, "revisit", first) if len(raw) >= 100 else (i, len(raw), digest, "response", None) for i in others]
    return Counter(out)


def got(df) -> Counter:
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    rows = [(i, f"https://h{rng.randrange(5)}.example.org/p{rng.randrange(30)}?q={i % 3}#f", rng.choice(["é" * 50, "x" * 99, "y" * 100, f"page {i} " * 30]), "k", "d", 1, "f") for i in range(120)]
    rows += [(200, None, None, None, None, None, None), (201, "", "", None, None, None, None), (202, "not a url \r\n\t\x00 é", "z" * 500, None, None, None, None), (None, "http://a.b/", "z" * 500, None, None, None, None)]
    rows += [(None, None, "n" * 300, None, None, None, None), (203, "http://EXAMPLE.com:8080", "w " * 600_000, None, None, None, None), (204, "http://u:p@[::1]:443/x", "漢" * 34 + "\r\n\r\n", None, None, None, None)]
    return rows + [rows[0], rows[0], rows[3], (300, rows[1][1], "hot " * 40, None, None, None, None)] + [(301 + i, "http://hot.example/", "hot " * 40, None, None, None, None) for i in range(90)]


def test_archives_equal_brute_force(spark, odd_rows):
    pages = spark.createDataFrame(odd_rows, PAGES).repartition(3)
    assert got(warc.archive_report(pages)) == brute(odd_rows)
    assert got(warc.archive_report(spark.createDataFrame([], PAGES))) == Counter()


def test_url_keys(spark):
    urls = {
        "http://blog.Example.COM/A?b=C#d": "com,example,blog)/A?b=C",
        "https://example.com": "com,example)/",
        "https://user@example.com:8443?x": "com,example:8443)/?x",
        "http://10.0.0.1:80/y": "10.0.0.1)/y",
        "http://[::1]:81/z": "[::1]:81)/z",
        "mailto:someone": "mailto:someone",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("key"))
    assert {r["url"]: r["key"] for r in rows.collect()} == urls


@pytest.mark.parametrize("shards", [1, 5])
def test_lookup_equals_filter(spark, tmp_path, shards):
    rng = random.Random(shards)
    rows = [(rng.choice(["com,hot)/", f"com,a)/{rng.randrange(200):04}", f"org,é)/{rng.randrange(40)}", "", "k" * 400 + str(rng.randrange(9))]), f"f{rng.randrange(3)}", i, 1) for i in range(3000)]
    captures = spark.createDataFrame(rows, "key string, file string, offset long, length long").repartition(4)
    path = f"file://{tmp_path}/i"
    directory = warc.write_capture_index(captures, path, shards, block_lines=20)
    assert directory.count() >= 150 and directory.select("shard").distinct().count() == shards
    asked = {r[0] for r in rows if rng.random() < 0.3} | {"com,hot)/", "absent", "zzz", "\u0001"}
    keys = spark.createDataFrame([(k,) for k in [*asked, None, "absent"]], "key string")
    found = Counter(tuple(r) for r in warc.lookup(keys, directory, path).collect())
    assert found == Counter(r for r in rows if r[0] in asked)


def test_records_are_warc(spark, odd_rows, tmp_path):
    pages = spark.createDataFrame(odd_rows, PAGES).repartition(2)
    path = f"file://{tmp_path}/w"
    captures = warc.write_archives(warc.record_plan(pages), path)
    ids, refers = set(), set()
    for r in captures.collect():
        data = (tmp_path / "w" / r["file"]).read_bytes()
        record = warc.parse_record(data[r["offset"] : r["offset"] + r["length"]])
        ids.add(record["warc"]["warc-record-id"])
        refers |= {record["warc"]["warc-refers-to"]} if record["warc"]["warc-type"] == "revisit" else set()
        assert record["payload"] is None or hashlib.sha256(record["payload"]).hexdigest() == record["warc"]["warc-payload-digest"].removeprefix("sha256:")
    assert len(ids) == len(odd_rows) and refers <= ids
    for f in (tmp_path / "w").glob("*.warc.gz"):  # the members of a file are one stream of records
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    urls = {r["warc"].get("warc-target-uri") for r in warc.read_records(captures, path).collect()}
    assert quote(odd_rows[122][1], safe="".join(map(chr, range(33, 127)))) in urls and None in urls


def test_payloads_below_the_bound_are_stored(spark):
    rows = [(i, f"http://a/{i}", "s" * 99, None, None, None, None) for i in range(50)]
    assert {r["record_type"] for r in warc.archive_report(spark.createDataFrame(rows, PAGES)).collect()} == {"response"}
