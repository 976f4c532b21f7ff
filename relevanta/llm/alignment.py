"""Alignment of two tokenizers' ids by inverted bitmaps of id pairs.

A text is encoded by a byte-level BPE (A, the text after one space) and by a piece vocabulary (B, which adds that space
itself). Both sequences cut the same bytes; offsets where tokens of both end part them into groups. An A and a B token are
linked where their bytes overlap.

Documents of a scan's partition are numbered in chunks of ``CHUNK``. For each pair of ids and chunk the index holds the
documents with that link as compressed bitmaps: plane k has the documents whose number of such links has bit k set, as a
list of 16-bit numbers or, above a 16th of a chunk, as bits. The OR of a pair's planes is its document bitmap, whose
popcounts add up to document counts; popcounts of plane k times 2^k add up to link counts. The index is dealt out by pair,
meets the pairs' counts there, and its postings return what each document scores, summed up chunk by chunk.

Words repeat, so a process keeps the alignment of each word that stands between single spaces or line feeds; both
tokenizers cut there. Texts with other white space are encoded whole. Texts are never shuffled.

Defined results: texts that are null, empty, or that either tokenizer does not give back byte by byte (U+2581 in a text,
for one) have no tokens; rows with one id are documents of their own, and so are rows without one; an empty table gives no
rows; other columns are ignored. A task holds one batch of texts, one chunk's postings and the words kept.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevanta.llm.common import CACHES, new_path
from relevanta.llm.tokens import PieceEncoder, byte_letters, default_tokenizer

CHUNK = 4096
#: A chunk ends early after so many words.
CHUNK_WORDS = 1_500_000
#: Planes with more documents are bits.
LISTED = CHUNK // 16
CACHE_WORDS = 400_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Encodes and aligns words and texts; keeps words. An entry is a word's or a text's numbers, links and groups."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.pieces = PieceEncoder(a_path, cache_entries=0, plain=True)
        self.a = self.pieces.tokenizer
        byte_of = {letter: byte for byte, letter in byte_letters(self.a).items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = self.a_size.tolist(), self.b_size.tolist()
        self.a_text, self.b_text = list(map(str, range(len(self.a_sizes)))), list(map(str, range(len(self.b_sizes))))
        self.clear()

    def clear(self) -> None:
        self.pieces.cache.clear()
        self.pieces.marks.clear()
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.links, self.starts = array("q"), array("q", [0])

    def _entry(self, raw: bytes, a: list[int], b: list[int]) -> int:
        """The number of a new entry; -1 if the tokens aren't the bytes."""
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return -1
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        segments = np.union1d(ends_a, ends_b)  # one overlapping pair a segment between two ends
        links = (np.asarray(a, np.int64)[np.searchsorted(ends_a, segments)] << 32) | np.asarray(b, np.int64)[np.searchsorted(ends_b, segments)]
        at = bt = 0
        groups = []
        for x, y in zip((np.searchsorted(ends_a, both) + 1).tolist(), (np.searchsorted(ends_b, both) + 1).tolist(), strict=True):
            groups.append(f"{','.join(map(str, a[at:x]))}|{','.join(map(str, b[bt:y]))}")
            at, bt = x, y
        return self._add(len(a), len(b), groups, links)

    def _short(self, a: list[int], b: list[int]) -> int:
        """The same for a word whose bytes are known to be both tokens', without arrays."""
        text_a, text_b = self.a_text, self.b_text
        if len(a) == 1 or len(b) == 1:
            links = [a[0] << 32 | y for y in b] if len(a) == 1 else [x << 32 | b[0] for x in a]
            return self._add(len(a), len(b), [f"{','.join([text_a[x] for x in a])}|{','.join([text_b[y] for y in b])}"], links)
        size_a, size_b = self.a_sizes, self.b_sizes
        groups, links, i, j, at, bt, end_a, end_b = [], [], 0, 0, 0, 0, size_a[a[0]], size_b[b[0]]
        while True:
            links.append(a[i] << 32 | b[j])
            if end_a == end_b:
                i, j = i + 1, j + 1
                groups.append(f"{','.join([text_a[x] for x in a[at:i]])}|{','.join([text_b[y] for y in b[bt:j]])}")
                if i == len(a):
                    return self._add(len(a), len(b), groups, links)
                at, bt, end_a, end_b = i, j, end_a + size_a[a[i]], end_b + size_b[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            else:
                j += 1
                end_b += size_b[b[j]]

    def _add(self, n_a: int, n_b: int, groups: list[str], links) -> int:
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.n_groups.append(len(groups))
        self.groups.append(";".join(groups))
        self.links.extend(links.tolist() if isinstance(links, np.ndarray) else links)
        self.starts.append(len(self.links))
        return len(self.groups) - 1

    def learn(self, words: list[str]) -> None:
        """Keeps new words; one that starts or ends in white space, or isn't given back, has no entry (-1)."""
        good = []
        for w in words:
            bare = w[1:] if w[:1] == "\n" else w
            if not bare or bare[0].isspace() or bare[-1].isspace():
                self.known[w] = -1
            else:
                good.append(w)
        if not good:
            return
        wholes = [(w if w[0] == "\n" else " " + w).encode() for w in good]
        a_ids = [array("i", self.pieces.piece(w)).tolist() for w in good]
        # before a line feed the added space is a token of its own
        b_ids = [ids[1:] if w[0] == "\n" else ids for w, ids in zip(good, self.b.encode(good, num_threads=1), strict=True)]
        a_bytes, b_bytes, known = self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.known
        for w, whole, a, b in zip(good, wholes, a_ids, b_ids, strict=True):
            known[w] = self._short(a, b) if b"".join(map(a_bytes, a)) == whole == b"".join(map(b_bytes, b)) else -1

    def whole(self, text: str) -> int:
        """The number of a whole text's entry, which isn't kept by text; -1 if it isn't given back."""
        return self._entry(b" " + text.encode(), self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text))

    def entries(self, texts: list[str | None]) -> list[list[int]]:
        """The entries of each text; none for a text without tokens."""
        split = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        self.learn(list({w for words in split for w in words if w not in self.known}))
        get, out = self.known.__getitem__, []
        for text, words in zip(texts, split, strict=True):
            found = list(map(get, words))
            if -1 in found:
                found = [n] if (n := self.whole(text)) >= 0 else []
            out.append(found)
        return out


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process."""
    return Aligner(a_path, b_path)


CACHES.append(aligner)


def encode_planes(key: np.ndarray, counts: np.ndarray, times: np.ndarray, pairs: int) -> list[bytes]:
    """The planes of ``pairs`` pairs from their documents' numbers ``key`` (ascending within a pair), how many documents each
    pair has, and how often each document has the link."""
    owner = np.repeat(np.arange(pairs), counts)
    parts: list[list[bytes]] = [[] for _ in range(pairs)]
    for k in range(int(times.max(initial=0)).bit_length()):
        has = (times >> k) & 1 == 1
        raw = key[has].astype("<u2").tobytes()
        numbers = np.bincount(owner[has], minlength=pairs)
        ends = np.cumsum(numbers)
        for p in np.flatnonzero(numbers).tolist():
            n, end = int(numbers[p]), int(ends[p])
            own = raw[2 * (end - n) : 2 * end]
            if n > LISTED:
                bits = np.zeros(CHUNK, np.uint8)
                bits[np.frombuffer(own, "<u2")] = 1
                own = np.packbits(bits, bitorder="little").tobytes()
            parts[p].append(k.to_bytes(1, "little") + n.to_bytes(2, "little") + own)
    return [b"".join(p) for p in parts]


def decode_planes(planes: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """``(k, document numbers)`` of each plane."""
    at = 0
    while at < len(planes):
        k, n = planes[at], planes[at + 1] | planes[at + 2] << 8
        at += 3
        size = 2 * n if n <= LISTED else CHUNK // 8
        own = planes[at : at + size]
        yield k, np.frombuffer(own, "<u2") if n <= LISTED else np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8), bitorder="little"))
        at += size


def document_bits(planes: bytes) -> np.ndarray:
    """The OR of the planes, as bytes of bits."""
    out = np.zeros(CHUNK, np.uint8)
    for _, numbers in decode_planes(planes):
        out[numbers] = 1
    return np.packbits(out, bitorder="little")


def or_merge(bitmaps: list[np.ndarray]) -> np.ndarray:
    """The documents of any of several bitmaps of one chunk."""
    return np.bitwise_or.reduce(bitmaps)


def popcount(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class _Chunk:
    def __init__(self, part: int, number: int):
        self.part, self.number = part, number
        self.ids: list = []
        self.entries, self.sizes, self.digests = array("i"), array("q"), []

    def add(self, doc_id, found: list[int], groups: list[str]) -> None:
        self.ids.append(doc_id)
        self.entries.extend(found)
        self.sizes.append(len(found))
        self.digests.append(hashlib.sha256(";".join(map(groups.__getitem__, found)).encode()).hexdigest() if found else "")

    def rows(self, codec: Aligner, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The chunk's documents, then its part of the index."""
        n = len(self.ids)
        doc = np.repeat(np.arange(n), np.frombuffer(self.sizes, np.int64))
        entries = np.frombuffer(self.entries, np.int32) if len(self.entries) else np.zeros(0, np.int32)
        starts = np.frombuffer(codec.starts, np.int64)
        lengths = np.diff(starts)
        total = lambda values: np.bincount(doc, values, n).astype(np.int64)
        numbers = [total(np.frombuffer(c, np.int64)[entries] if len(entries) else entries) for c in (codec.n_a, codec.n_b, codec.n_groups)]
        docs = [pa.array(self.ids, id_type), *map(pa.array, numbers), pa.array(total(lengths[entries] if len(entries) else entries)), pa.array(self.digests)]
        yield self._batch("doc", n, [pa.array(np.arange(n, dtype=np.int32)), *docs], 0)
        if not len(entries):
            return
        # each different (document, entry) once, then its links, then each different (pair, document) once
        packed, often = np.unique(doc.astype(np.int64) << 32 | entries, return_counts=True)
        doc, entry = packed >> 32, packed & 0xFFFFFFFF
        used, entry = np.unique(entry, return_inverse=True)
        flat = np.frombuffer(codec.links, np.int64)
        size = lengths[used]
        pairs, pair = np.unique(flat[_ranges(starts[used], size)], return_inverse=True)
        first = np.cumsum(size) - size
        link = pair[_ranges(first[entry], size[entry])]
        key, at = np.unique(link * CHUNK + np.repeat(doc, size[entry]), return_inverse=True)
        times = np.bincount(at, np.repeat(often, size[entry])).astype(np.int64)
        owner = key // CHUNK
        counts = np.bincount(owner, minlength=len(pairs))
        planes = encode_planes(key % CHUNK, counts, times, len(pairs))
        links = np.bincount(owner, times).astype(np.int64)
        for i in range(0, len(pairs), 20_000):
            j = slice(i, i + 20_000)
            own = [pa.array((pairs[j] >> 32).astype(np.int32)), pa.array((pairs[j] & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[j].astype(np.int32)), pa.array(links[j]), pa.array(planes[j], pa.binary())]
            yield self._batch("pair", len(own[0]), own, 7, id_type)

    def _batch(self, kind: str, n: int, own: list, at: int, id_type: pa.DataType | None = None) -> pa.RecordBatch:
        types = [pa.int32(), id_type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        columns = [pa.nulls(n, t) if t is not None else None for t in types]
        columns[at : at + len(own)] = own
        head = [pa.array([kind] * n), pa.array(np.full(n, self.part, np.int32)), pa.array(np.full(n, self.number, np.int32))]
        return pa.RecordBatch.from_arrays([*head, *columns], names=["kind", "part", "chunk", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "docs", "links", "planes"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def write_index(docs: DataFrame, path: str, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes and aligns ``docs`` where they are read; writes ``kind=doc`` and ``kind=pair`` below ``path``."""
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()
    id_sql = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, codec, chunk, kind = TaskContext.get().partitionId(), aligner(a_path, b_path), None, None
        for batch in batches:
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 256):
                for doc_id, found in zip(ids[i : i + 256], codec.entries(texts.slice(i, 256).to_pylist()), strict=True):
                    chunk = chunk or _Chunk(part, 0)
                    chunk.add(doc_id, found, codec.groups)
                    if len(chunk.ids) == CHUNK:
                        yield from chunk.rows(codec, kind)
                        chunk = _Chunk(part, chunk.number + 1)
                if chunk and len(chunk.entries) > CHUNK_WORDS or len(codec.links) > 20 * CACHE_WORDS:
                    yield from chunk.rows(codec, kind)
                    chunk = _Chunk(part, chunk.number + 1)
                if len(codec.known) > CACHE_WORDS or len(codec.links) > 20 * CACHE_WORDS:
                    if chunk.ids:
                        yield from chunk.rows(codec, kind)
                        chunk = _Chunk(part, chunk.number + 1)
                    codec.clear()
        if chunk and chunk.ids:
            yield from chunk.rows(codec, kind)

    schema = f"kind string, part int, chunk int, number int, doc_id {id_sql}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs int, links long, planes binary"
    docs.select(id_col, text_col).mapInArrow(run, schema).write.partitionBy("kind").parquet(path)


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links`` of every pair of ids, from its bitmaps' popcounts."""
    return index.groupBy("a", "b").agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("links").alias("n_links"))


def weighted(counts: DataFrame) -> DataFrame:
    """``a, b, count, best``: whether no other A id has more links with the B id."""
    most = counts.groupBy("b").agg(F.max("n_links").alias("_most"))
    return counts.join(most, "b").select("a", "b", F.col("n_links").alias("count"), (F.col("n_links") == F.col("_most")).alias("best"))


def documents_with(index: DataFrame, by: str) -> DataFrame:
    """``by, n_docs``: in how many documents an id of one side is linked, its pairs' bitmaps OR-merged chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, merged = None, None
        for batch in batches:
            found = []
            for key, planes in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(3).to_pylist(), strict=True):
                bits = document_bits(planes)
                if key != last:
                    found += [(last[0], popcount(merged))] if last else []
                    last, merged = key, bits
                else:
                    merged = or_merge([merged, bits])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())], names=[by, "n"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([popcount(merged)], pa.int64())], names=[by, "n"])

    keys = [by, "part", "chunk"]
    rows = index.select(*keys, "planes").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{by} int, n long")
    return rows.groupBy(by).agg(F.sum("n").alias("n_docs"))


def posting_scores(index: DataFrame, weights: DataFrame) -> DataFrame:
    """``part, chunk, number, n_best, count_sum`` of every document with a link: what the postings of its pairs return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, total = None, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)

        def give() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            out = [np.full(len(at), last[0], np.int32), np.full(len(at), last[1], np.int32), at.astype(np.int32), best[at], total[at]]
            best[:], total[:] = 0, 0
            return pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["part", "chunk", "number", "n_best", "count_sum"])

        for batch in batches:
            for part, chunk, planes, count, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, chunk) != last:
                    if last:
                        yield give()
                    last = part, chunk
                for k, numbers in decode_planes(planes):
                    total[numbers] += count << k
                    if top:
                        best[numbers] += 1 << k
        if last:
            yield give()

    rows = index.join(weights, ["a", "b"]).select("part", "chunk", "planes", "count", "best")
    return rows.repartition("part", "chunk").sortWithinPartitions("part", "chunk").mapInArrow(run, "part int, chunk int, number int, n_best long, count_sum long")


def alignment_report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    spark = docs.sparkSession
    path = new_path(spark, "pair-index")
    write_index(docs, path)
    read = spark.read.schema(f"part int, chunk int, number int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs int, links long, planes binary, kind string").parquet(path)
    index = read.filter("kind = 'pair'").select("a", "b", "part", "chunk", "docs", "links", "planes")
    scores = posting_scores(index.drop("docs", "links"), weighted(pair_counts(index)))
    rows = read.filter("kind = 'doc'").select("part", "chunk", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rows = rows.join(scores, ["part", "chunk", "number"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
