"""Near-duplicate documents by order MinHash.

A text's k-mers are runs of two words, labelled with their occurrence, so that a repeated run counts as often as it
occurs. Each of ``sketches`` hash functions picks the two labelled k-mers with the smallest values and keeps them in the
order of the text; two texts agree in such a pair more often the more alike they are in edit distance. Texts that agree
in one sketch stand in one bucket. A pair is linked where the word-level edit similarity, 1 - distance / longer length, is
at least ``threshold``; the alignment is banded by the largest distance that allows it.

Exact copies are one node from the start, so a group of copies costs one row each. In a bucket of at most COMPLETE texts
all pairs are candidates; each text is first aligned with the one it meets most often, and then only with those that are not
in its class by then, as more links within a class change nothing. A larger one comes from a large group of near copies or from a passage that many texts share. Its
texts are aligned with two leaders, which joins near copies; of a text that is unlike the leader it meets most often, what
that leader doesn't have is sketched again, and texts that agree in such a sketch stand in one bucket in turn. That joins
most; every other pair of a large bucket is compared too, in blocks of BLOCK texts that are aligned where they meet, unless
its two texts are in one class by then: more links between these change nothing. So a large group of near copies costs few
alignments and no rows, and texts that share a passage and are unlike cost all of theirs. Candidates whose lengths or bags
(counts of hashed words, which bound the distance from below; in large buckets and of long texts then finer ones) show that
they are unlike are not aligned. Leaders' texts are dealt out to several tasks where they
have many partners.

Defined results: null and empty texts are copies of one another; a text of one word is one k-mer; texts of under SHORT words, and
longer ones that can pair with them, are sketched by single words as well; a row without an
id takes no part (component null, kept); rows with one id are one document, linked with all that any of them is linked
with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevanta.llm.common import block_pairs, chunks, free_caches, groups_of, list_array, staged, texts_of, whole_groups
from relevanta.llm.components import connected_components

#: An edit spoils two runs of two words. At similarity 0.8 at least three fifths of them are left, even if edits never touch
#: one run together: two texts then agree in a sketch with probability 0.17 or more, in some of 32 with 0.997.
WORDS, SKETCHES = 2, 32
THRESHOLD = 0.8
#: Texts of fewer words are also sketched by runs of SHORT_WORDS words, and so is every text that a threshold of
#: THRESHOLD lets pair with one of them.
SHORT, SHORT_WORDS, SHORT_SKETCHES = 50, 1, 32
#: Partners of one leader that one task aligns.
PARTNERS = 256
#: Cells of a bag, and of the finer one that pairs of a large bucket meet after it.
BAG, FINE = 128, 2048
#: Texts of a bucket whose pairs are all candidates, and the sketches of what a leader of a larger one doesn't have.
COMPLETE = 64
AGAIN_WORDS, AGAIN = 2, 12
#: Texts of a block: two blocks of a larger bucket's texts meet in one task at a time.
BLOCK = 2048
#: Words of a block's texts; a bucket of longer texts has more blocks. Pairs that a task holds before it aligns them.
BLOCK_WORDS, PAIRS = 500_000, 500_000
#: Texts of more words meet in finer bags before they are aligned.
LONG = 1000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


#: A number to flip the bits of a hash with and an odd one to multiply it by, for each sketch.
_SEEDS = _mix(np.arange(1, 257, dtype=np.uint64).reshape(-1, 2)) | np.array([0, 1], np.uint64)

_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(256)], np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z in lower case, and the number of words of each text."""
    data = _LOWER[np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)]
    space = _SPACE[data]
    # the separator after each text tells texts apart
    sizes = np.array([len(t.encode()) for t in texts], np.int64) + 1
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = np.cumsum(~space & np.r_[True, space[:-1]]) - 1
    place = np.arange(len(data)) - start[np.maximum(word, 0)]
    values = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255] * (np.uint64(2) * (place >> 8).astype(np.uint64) + np.uint64(1)))
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return _mix(np.add.reduceat(values, start)), np.bincount(owner, minlength=len(texts))


def labelled_kmers(hashes: np.ndarray, counts: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of all texts in order, hashed with the number of their occurrence, and how many each text has."""
    full = counts > 0
    n, own = counts[full], np.where(full, np.maximum(counts - k + 1, 1), 0)
    if not len(n):
        return np.zeros(0, np.uint64), own
    first, of_text = np.cumsum(n) - n, own[full]
    owner = np.repeat(np.arange(len(n)), of_text)
    at = np.arange(of_text.sum()) - np.repeat(np.cumsum(of_text) - of_text, of_text) + first[owner]
    gram = np.zeros(len(at), np.uint64)
    short = n[owner] < k
    last = first[owner] + n[owner]
    for i in range(k):
        here = at + i
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + np.where(short & (here >= last), np.uint64(7), hashes[np.minimum(here, len(hashes) - 1)])
    gram = _mix(gram)
    # occurrence number of each k-mer in its text
    key = gram ^ _mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    begins = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    run = np.flatnonzero(begins)
    seen = np.empty(len(key), np.uint64)
    seen[order] = np.arange(len(key)) - run[np.cumsum(begins) - 1]
    return _mix(gram + seen * _B), own


def order_sketches(labelled: np.ndarray, own: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """(texts, sketches) integers; equal where two texts' two smallest labelled k-mers agree in text order. Texts without k-mers give rows of 0."""
    out = np.zeros((len(own), sketches), np.uint64)
    full = np.flatnonzero(own)
    if not len(full):
        return out.view(np.int64)
    own = own[full]
    starts, most = np.cumsum(own) - own, np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        # a text's labelled k-mers are all different, so each minimum stands in one place
        value = (labelled ^ _SEEDS[s, 0]) * _SEEDS[s, 1]
        one = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), own))
        value[one] = most
        two = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), own))
        a, b = labelled[np.minimum(one, two)], labelled[np.maximum(one, two)]
        out[full, s] = _mix(a * np.uint64(3) + b + np.uint64(s)) | np.uint64(1)
    return out.view(np.int64)


def sketches_beyond(leader: np.ndarray, texts: list[str], sketches: int) -> list[list[int]]:
    """Sketches of each text's labelled k-mers that are not among the leader's; none where too few are left."""
    labelled, own = labelled_kmers(*word_hashes(texts), AGAIN_WORDS)
    beyond = ~np.isin(labelled, leader)
    owner = np.repeat(np.arange(len(own)), own)
    left = np.bincount(owner[beyond], minlength=len(own))
    return [keys if n > 1 else [] for keys, n in zip(order_sketches(labelled[beyond], left, sketches).tolist(), left, strict=True)]


def bags(hashes: np.ndarray, counts: np.ndarray, cells: int = BAG, most: int = 255) -> np.ndarray:
    """(texts, cells) counts of words by a hash, ``most`` at most."""
    cell = np.repeat(np.arange(len(counts)), counts) * cells + (hashes % np.uint64(cells)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(counts) * cells), most).astype(np.min_scalar_type(most)).reshape(-1, cells)


def fine_bags(hashes: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """Each text's counts in FINE cells, as the numbers of the cells it uses and the counts there, 16 bits each."""
    first = np.cumsum(counts) - counts
    for i, n in zip(first.tolist(), counts.tolist(), strict=True):
        cell, count = np.unique((hashes[i : i + n] % np.uint64(FINE)).astype(np.uint16), return_counts=True)
        yield cell.tobytes() + np.minimum(count, 65535).astype(np.uint16).tobytes()


def _fine_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(texts, FINE) counts out of what ``fine_bags`` made."""
    rows = [np.frombuffer(x, np.uint16).reshape(2, -1) for x in column.to_pylist()]
    out = np.zeros((len(rows), FINE), np.uint16)
    for row, (cell, count) in zip(out, rows, strict=True):
        row[cell] = count
    return out


def may_be_alike(bags_u: np.ndarray, bags_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, threshold: float) -> np.ndarray:
    """False for pairs of rows that cannot reach ``threshold``: each edit mends one missing word at most."""
    most = ((1 - threshold) * np.maximum(n_u, n_v) + 1e-9).astype(np.int64)
    out = np.abs(n_u - n_v) <= most
    at = np.flatnonzero(out)
    step = 50_000 * BAG // bags_v.shape[1] if len(bags_v) else 1
    for i in range(0, len(at), step):
        own = at[i : i + step]
        apart = np.abs(bags_u[own].astype(np.int32) - bags_v[own]).sum(1, dtype=np.int64)
        out[own] = apart + np.abs(n_u[own] - n_v[own]) <= 2 * most[own]
    return out


def _bag_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BAG)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``. Only diagonals within the band are
    kept, as the bits of one integer that slides along the main diagonal."""
    if len(a) < len(b):
        a, b = b, a
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not b or len(a) - len(b) > most:
        return min(len(a), most + 1) if not b else most + 1
    most_ = min(most, len(a))
    width = 2 * most_ + 2
    mask, where = (1 << width) - 1, {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    vp, vn, distance = (mask << (width - most_ - 1)) & mask, 0, most_
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    shift, down = most_ + 1 - width, len(a) - most_
    for i, x in enumerate(b):
        hits = where.get(x, 0)
        hits = (hits >> shift if shift >= 0 else hits << -shift) & mask
        d0 = ((((hits & vp) + vp) ^ vp) | hits | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if i < down:
            distance += not d0 & diagonal
        else:
            distance += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        shift += 1
    return min(distance, most + 1)


def alike(a: list, b: list, threshold: float, bag_a: Counter | None = None) -> bool:
    """Whether the edit similarity of two word lists is at least ``threshold``."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if longer > 8:  # each edit mends one missing word at most
        bag = (bag_a if bag_a is not None else Counter(a)).copy()
        bag.subtract(b)
        if max(sum(v for v in bag.values() if v > 0), -sum(v for v in bag.values() if v < 0)) > most:
            return False
    return banded_distance(a, b, most) <= most


def sketch_documents(docs: DataFrame, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, copy, n_words, sketches, short_sketches, bag)``; ``copy`` is a digest equal for exact copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in chunks(texts, 400_000):
                hashes, counts = word_hashes(texts[i:j])
                rows, short = order_sketches(*labelled_kmers(hashes, counts), sketches), counts * THRESHOLD < SHORT
                more = _mix(order_sketches(*labelled_kmers(hashes[np.repeat(short, counts)], counts[short], SHORT_WORDS), SHORT_SKETCHES).view(np.uint64)).view(np.int64)
                lists = [list_array(x.ravel(), n, pa.int64()) for x, n in ((rows, np.full(j - i, sketches)), (more, np.where(short, SHORT_SKETCHES, 0)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(counts), *lists, pa.array([x.tobytes() for x in bags(hashes, counts)], pa.binary())], names=["doc_id", "copy", "n_words", "sketches", "short_sketches", "bag"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("copy"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, copy string, n_words long, sketches array<long>, short_sketches array<long>, bag binary")


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """``(u, v, alike, keys)`` of the pairs ``(u, v, hot)`` whose texts are alike, and of those with ``hot`` that are not:
    these have the sketches of what ``u`` doesn't have of ``v``. ``words`` has ``(node, text)``.

    A leader ``u`` meets its partners group by group, PARTNERS at most in one, so that no leader fills a task; a group
    streams past, one batch of texts at a time.
    """
    groups = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("_groups"))
    partners = pairs.join(groups, "u").select("u", "v", "hot", F.pmod(F.xxhash64("v"), F.col("_groups")).cast("int").alias("_group"))
    # texts are always shuffled: at scale neither side of these joins is small
    partners = partners.join(words.withColumnRenamed("node", "v").hint("merge"), "v").select("u", "_group", F.lit(1).alias("_side"), "v", "hot", "text")
    leaders = groups.join(words.withColumnRenamed("node", "u").hint("merge"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"), F.lit(0).alias("_side"), F.col("u").alias("v"), F.lit(False).alias("hot"), "text")
    both = leaders.unionByName(partners).repartition("u", "_group").sortWithinPartitions("u", "_group", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        leader, bag, text_u, kmers = [], Counter(), "", None
        for batch in batches:
            found, beyond = [], []  # beyond: partners of the leader at hand that are unlike it

            def hand_on(u: int, found: list, beyond: list) -> None:
                nonlocal kmers
                for i, j in chunks([t for _, t in beyond], 400_000):
                    if kmers is None:
                        kmers = labelled_kmers(*word_hashes([text_u]), AGAIN_WORDS)[0]
                    keys = sketches_beyond(kmers, [t for _, t in beyond[i:j]], AGAIN)
                    found += [(u, v, False, own) for (v, _), own in zip(beyond[i:j], keys, strict=True) if own]

            last = None
            for u, side, v, hot, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), batch.column(5), strict=True):
                text = text.as_py()
                own = text.encode().lower().split()
                if side == 0:
                    hand_on(last, found, beyond)
                    beyond, leader, bag, text_u, kmers = [], own, Counter(own), text, None
                elif alike(leader, own, threshold, bag):
                    found.append((u, v, True, None))
                elif hot:
                    beyond.append((v, text))
                last = u
            hand_on(last, found, beyond)
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)], names=["u", "v", "alike", "keys"])

    return both.mapInArrow(run, "u long, v long, alike boolean, keys array<long>")


def possible(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(u, v, met)`` that their lengths and bags don't rule out. ``own`` has ``(node, n, bag)``."""
    for side in ("u", "v"):
        pairs = pairs.join(own.select(F.col("node").alias(side), F.col("n").alias(f"_n{side}"), F.col("bag").alias(f"_bag{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for batch in batches:
            n = [np.asarray(batch.column(c)).astype(np.int64) for c in (3, 4)]
            yield batch.select([0, 1, 2]).filter(pa.array(may_be_alike(_bag_matrix(batch.column(5)), _bag_matrix(batch.column(6)), *n, threshold)))

    near = F.least("_nu", "_nv") >= F.greatest("_nu", "_nv") * F.lit(threshold) - F.lit(1e-6)
    return pairs.filter(near).select("u", "v", "met", "_nu", "_nv", "_bagu", "_bagv").mapInArrow(run, "u long, v long, met long")


def within_buckets(members: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """All pairs ``(u, v)`` of a small bucket's members ``(key, node)`` that their bags don't rule out, with ``met``, in how many
    buckets they meet. ``own`` has ``(node, n, bag)``."""
    rows = members.join(own.hint("merge"), "node").select("key", "node", "n", "bag").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for batch in whole_groups(batches):
            key, node, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "n"))
            bag, at = _bag_matrix(batch.column("bag")), np.arange(len(node))
            for step in range(1, COMPLETE):  # each row with the one ``step`` rows on
                a = at[:-step][key[:-step] == key[step:]]
                if not len(a):
                    break
                b = a + step
                fits = (node[a] < node[b]) & (np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * threshold - 1e-6)
                a, b = a[fits], b[fits]
                good = may_be_alike(bag.take(a, 0), bag.take(b, 0), n[a], n[b], threshold) if len(a) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(node[a[good]]), pa.array(node[b[good]])], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long").groupBy("u", "v").agg(F.count("*").alias("met"))


def candidates(keyed: DataFrame, own: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``(u, v, met, hot)`` from ``keyed(key, node)``: in small buckets all, in large ones those with a leader,
    which are ``hot`` where a text meets no leader more often; and the members ``(key, node)`` of large ones. ``met``
    is 0 where bags rule the pair out. ``own`` has ``(node, n, bag)``."""
    buckets = staged(keyed.groupBy("key").agg(F.count("*").alias("_size"), F.min("node").alias("_first"), F.max("node").alias("_second")).filter("_size > 1"), "buckets")
    bucketed = staged(keyed.join(buckets, "key"), "bucketed")
    small = within_buckets(bucketed.filter(F.col("_size") <= COMPLETE).select("key", "node"), own, threshold)
    large = bucketed.filter(F.col("_size") > COMPLETE)
    led = [large.groupBy(F.col(c).alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("met")) for c in ("_first", "_second")]
    led = staged(led[0].unionByName(led[1]).filter("u <> v").groupBy("u", "v").agg(F.sum("met").alias("met")), "led")
    most = led.groupBy("v").agg(F.max_by("u", F.struct("met", -F.col("u"))).alias("u"))
    pairs = small.unionByName(possible(led, own, threshold)).withColumn("hot", F.lit(False))
    # whatever its bag says, what the leader it meets most often doesn't have of a text is sketched
    pairs = pairs.unionByName(most.select("u", "v", F.lit(0).cast("long").alias("met"), F.lit(True).alias("hot"))).groupBy("u", "v").agg(F.sum("met").alias("met"), F.bool_or("hot").alias("hot"))
    return pairs, large.select("key", "node")


def first_of(pairs: DataFrame) -> DataFrame:
    """Of candidates ``(u, v, met, hot)`` the ``hot`` ones and each text's pair with the one it meets most often."""
    often = Window.partitionBy("v").orderBy(F.desc("met"), "u")
    return pairs.withColumn("_n", F.row_number().over(often)).filter("hot or _n = 1").drop("_n")


def in_two_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(u, v, ...)`` whose texts are not in one class of ``classes(node, component)``, which has all nodes with links."""
    both = pairs
    for side in ("u", "v"):
        both = both.join(classes.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    return both.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select(*pairs.columns)


def with_fine_bags(texts: DataFrame) -> DataFrame:
    """``(node, n, fine)`` of those of ``texts(node, text)`` that have more than LONG words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for batch in batches:
            own = texts_of(batch.column(1))
            for i, j in chunks(own, 400_000):
                hashes, counts = word_hashes(own[i:j])
                long = counts > LONG
                fine = pa.array(fine_bags(hashes[np.repeat(long, counts)], counts[long]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(long)), pa.array(counts[long]), fine], names=["node", "n", "fine"])

    return texts.filter(F.length("text") > LONG).select("node", "text").mapInArrow(run, "node long, n long, fine binary")


def finer(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(u, v, met, hot)`` without those of two long texts that finer bags rule out; hot ones stay, with ``met`` 0.
    Of long texts the alignment costs most, and bags of few cells tell least."""
    fine = staged(with_fine_bags(texts), "fine")
    for side in ("u", "v"):
        pairs = pairs.join(fine.select(F.col("node").alias(side), F.col("n").alias(f"_n{side}"), F.col("fine").alias(f"_fine{side}")), side, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for batch in batches:
            met, hot = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            at = np.flatnonzero(pc.and_(batch.column(6).is_valid(), batch.column(7).is_valid()).to_numpy(zero_copy_only=False))
            for own in (at[i : i + 500] for i in range(0, len(at), 500)):
                n = [batch.column(c).take(pa.array(own)).to_numpy().astype(np.int64) for c in (4, 5)]
                met[own[~may_be_alike(*(_fine_matrix(batch.column(c).take(pa.array(own))) for c in (6, 7)), *n, threshold)]] = 0
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met), batch.column(3)], names=["u", "v", "met", "hot"])
            yield out.filter(pa.array((met > 0) | hot))

    return pairs.select("u", "v", "met", "hot", "_nu", "_nv", "_fineu", "_finev").mapInArrow(run, "u long, v long, met long, hot boolean")


def links_of_group(n: np.ndarray, node: np.ndarray, class_: np.ndarray, texts: list[str], mine: Callable[[int, int], bool], threshold: float) -> list[tuple[int, int]]:
    """Links among texts sorted by their length ``n`` that join all classes that links among them join. Pairs that neither
    bags nor finer ones rule out are aligned, those that are nearest by these first, unless their classes are one by then
    or the pair is not ``mine`` and not very near."""
    coarse, fine = np.zeros((len(n), BAG), np.uint8), np.zeros((len(n), FINE), np.uint16)
    for at in range(0, len(n), 256):
        for i, j in chunks(texts[at : at + 256], 400_000):
            hashes, counts = word_hashes(texts[at + i : at + j])
            coarse[at + i : at + j], fine[at + i : at + j] = bags(hashes, counts), bags(hashes, counts, FINE, 65535)
    longest, root, words, links = np.searchsorted(n, n / threshold + 1e-6, side="right"), class_.copy(), {}, []

    def align(held: list[np.ndarray]) -> None:
        for apart, a, b in sorted(map(tuple, np.concatenate(held).tolist())):
            most = int((1 - threshold) * n[b] + 1e-9)
            # a pair that is surely alike spares others, whoever else aligns it
            if root[a] == root[b] or (apart > most and not mine(a, b)):
                continue
            own = [words.get(x) or words.setdefault(x, texts[x].encode().lower().split()) for x in (a, b)]
            if banded_distance(*own, most) <= most:
                links.append((int(node[a]), int(node[b])))
                root[root == root[b]] = root[a]

    held, left = [], 0
    for a in range(len(n) - 1):
        b = np.arange(a + 1, longest[a])
        b = b[root[b] != root[a]]
        for counts in (coarse, fine):
            if len(b):
                b = b[may_be_alike(np.broadcast_to(counts[a], (len(b), counts.shape[1])), counts[b], np.broadcast_to(n[a], len(b)), n[b], threshold)]
        if len(b):
            apart = np.abs(fine[b].astype(np.int32) - fine[a]).sum(1, dtype=np.int64)
            held.append(np.stack([apart, np.full(len(b), a), b], 1))
            left += len(b)
        if left > PAIRS:
            align(held)
            held, left = [], 0
    if held:
        align(held)
    return links


def between_classes(large: DataFrame, classes: DataFrame, own: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``(u, v)`` that join whatever links between members ``(key, node)`` of one bucket join: every pair in different
    classes is compared, unless links found in its task have made these one. ``classes`` has ``(node, component)`` of nodes
    with links, ``own`` ``(node, n, bag)``, ``texts`` ``(node, text)`` of all members.

    A pair that meets in several buckets is aligned in the one with the smallest key, so a task hands on links between
    classes and no pairs."""
    members = large.join(own.select("node", "n").hint("merge"), "node").join(classes, "node", "left")
    members = staged(members.select("key", "node", "n", F.coalesce("component", "node").alias("class")), "classed")
    mixed = members.groupBy("key").agg(F.min("class").alias("_a"), F.max("class").alias("_b"), F.count("*").alias("_rows"), F.sum("n").alias("_words")).filter("_a < _b")
    size = F.greatest(F.col("_rows"), F.ceil(F.col("_words") * F.lit(BLOCK / BLOCK_WORDS)))
    members = staged(members.join(mixed.select("key", size.alias("_size")), "key"), "mixed")
    # a text is in as many buckets as it has sketches, at most; written, so that Spark sees how few these texts are
    asking = staged(members.groupBy("node").agg(F.collect_set("key").alias("keys")), "asking")
    rows = block_pairs(members.join(texts.join(asking, "node"), "node"), "key", "_size", "node", BLOCK).select("key", "_i", "_j", "n", "node", "class", "keys", "text")
    rows = rows.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for group in groups_of(batches, 3):
            n, node, class_ = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "node", "class"))
            if (class_ == class_[0]).all():
                continue
            key, keys = group.column("key")[0].as_py(), group.column("keys")
            lower = functools.cache(lambda x: frozenset(k for k in keys[x].as_py() if k < key))
            links = links_of_group(n, node, class_, group.column("text").to_pylist(), lambda a, b: lower(a).isdisjoint(lower(b)), threshold)
            u, v = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def asked_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the few that later pairs ask for; the ids are written first, so that Spark sees how few they are."""
    return texts.join(staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes"), "node", "left_semi")


def joined(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes(node, component)`` after ``links(u, v)``. Only classes that a link joins are gone through."""
    if links.isEmpty():
        return classes
    for side in ("u", "v"):
        links = links.join(classes.select(F.col("node").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    merged = staged(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("_to")), "merged")
    alone = merged.join(classes.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("_to").alias("component"))
    moved = classes.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return staged(moved.unionByName(alone), "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, component_id`` (smallest id of its class), ``kept`` (it is that document)."""
    rows = staged(sketch_documents(docs, sketches, id_col, text_col), "sketches")
    named = rows.filter(F.col("doc_id").isNotNull())
    copies = staged(named.groupBy("copy").agg(F.min("doc_id").alias("node")), "copies")  # written, so that Spark can split a hot copy in the joins
    members = named.select("doc_id", "copy").distinct().join(copies, "copy").select("doc_id", "node")
    own = named.join(copies.select(F.col("node").alias("doc_id"), "copy"), ["doc_id", "copy"], "left_semi").filter("n_words > 0").dropDuplicates(["doc_id", "copy"])
    bag_of = staged(own.select(F.col("doc_id").alias("node"), F.col("n_words").cast("int").alias("n"), "bag"), "bags")
    keyed = staged(own.select(F.col("doc_id").alias("node"), F.explode(F.concat("sketches", "short_sketches")).alias("key")), "keys")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.col("node").isNotNull())

    asked, large = candidates(keyed, bag_of, threshold)
    asked = staged(asked, "candidates")
    nodes = asked.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = staged(texts.join(nodes.hint("merge"), "node", "left_semi"), "texts")
    asked = staged(finer(asked, texts, threshold), "finer")
    # near copies are joined by one pair a text; of the other pairs only those between classes are left to align
    first = staged(first_of(asked), "first")
    found = staged(verified(first, texts, threshold), "found")
    links = found.filter("alike").select("u", "v").unionByName(members.filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    classes = staged(connected_components(links), "classes")
    # texts that are unlike their leader may be alike in what it doesn't have
    beyond = found.filter("not alike").select(F.col("v").alias("node"), F.explode("keys").alias("key"))
    again, large_again = candidates(staged(beyond, "keys"), bag_of, threshold)
    again = in_two_classes(asked.unionByName(again).filter("met > 0").select("u", "v").distinct(), classes)
    again = staged(again.join(first, ["u", "v"], "left_anti").withColumn("hot", F.lit(False)), "candidates")
    more = verified(again, asked_texts(again, texts), threshold).filter("alike").select("u", "v")
    more = more.unionByName(between_classes(large.unionByName(large_again), classes, bag_of, texts, threshold))
    classes = joined(staged(more, "links"), classes)
    classes = classes.withColumnRenamed("node", "doc_id")
    out = rows.select("doc_id").join(classes, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
