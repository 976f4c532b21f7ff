"""Near-duplicate vectors by p-stable hashing, and nearest neighbours by a forest of hash prefixes.

Both take vectors of any number type and length; vectors of different lengths have nothing to do with one another.
Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id.

Defined results of ``near_duplicate_vectors``: such rows come out with no links, their own id as component and ``kept``;
rows that repeat an id are one vector each and share what any of them links to; an empty table gives no rows.
``nearest_neighbours``: a query never meets rows of its own id; fewer candidates than asked for are all returned; ties
go to the smaller id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.llm.common import block_pairs, groups_of, staged
from relevanta.llm.components import connected_components

#: Tables, projections a table and their quantum: a pair at cosine 0.9 shares a bucket of some table with probability
#: 0.95, at 0.92 with 0.99, at 0.95 with 0.9999; a random pair shares one of a table's with probability 1e-5.
TABLES, PROJECTIONS, QUANTUM = 80, 12, 1.5
#: A bucket above BLOCK vectors is split by EXTRA more projections, SPLITS times over, and what is still larger once again:
#: a pair at cosine 0.9 of one bucket shares one of the parts with probability 0.99.
EXTRA, SPLITS, LEVELS = 4, 12, 2
#: Buckets up to SMALL are compared member by member by a join, larger ones as matrices of at most BLOCK vectors.
SMALL, BLOCK, TILE = 16, 4096, 512
#: Signs of 64 random projections in which two vectors of a small bucket may differ; at cosine 0.9 it is 9, give or take
#: 3, and more than 26 with probability 1e-7.
APART = 26


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length in a list column, with their vectors as doubles."""
    sizes = np.asarray(column.value_lengths())
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, np.asarray(column.take(pa.array(rows)).flatten(), float).reshape(len(rows), width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that none is too small or too large to be squared."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Normalised vectors of a list column whose lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(np.asarray(column.flatten(), float).reshape(len(column), -1))


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` (of length 1) have a cosine of at least ``threshold``. Where a matrix product could
    round either way, the rows are multiplied one by one, as ``_near`` does, so that both always agree."""
    cosine = x @ y.T
    out = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    out[i, j] = (x[i] * y[j]).sum(1) >= threshold
    return out


def _hashed(vectors: DataFrame, tables: int, seed: int) -> DataFrame:
    """``(node, keys, parts, bits)``: a bucket in each table, the part in each split of each level, and 64 signs of random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = LEVELS * SPLITS
        for batch in batches:
            keys, parts, bits = np.zeros((batch.num_rows, tables), np.int64), np.zeros((batch.num_rows, splits), np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, x in _matrix(batch.column(1)):
                rng, unit = np.random.default_rng([seed, x.shape[1]]), _unit(x)
                odd = rng.integers(1, 1 << 62, PROJECTIONS, dtype=np.int64) | 1
                for out, count, wide, salt in ((keys, tables, PROJECTIONS, x.shape[1] * 1009), (parts, splits, EXTRA, 0)):
                    cells = np.floor(unit @ rng.standard_normal((x.shape[1], count * wide)) / QUANTUM + rng.random(count * wide)).astype(np.int64)
                    with np.errstate(over="ignore"):
                        out[rows] = (cells.reshape(-1, count, wide) * odd[:wide]).sum(2) * 1_000_003 + np.arange(count) + salt
                signs = unit @ rng.standard_normal((x.shape[1], 64)) > 0
                bits[rows] = np.packbits(signs, axis=1).view(">i8").ravel().astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (keys, parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(bits)], names=["node", "keys", "parts", "bits"])

    return vectors.select("node", "v").mapInArrow(run, "node long, keys array<long>, parts array<long>, bits long")


def _near(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose cosine in double precision is at least ``threshold``."""
    for side in ("u", "v"):
        pairs = pairs.join(vectors.select(F.col("node").alias(side), F.col("v").alias(f"_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, good = np.asarray(batch.column(2).value_lengths()), np.zeros(batch.num_rows, bool)
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                a, b = (_units(batch.column(c).take(pa.array(rows))) for c in (2, 3))
                good[rows] = (a * b).sum(1) >= threshold
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.filter(F.size("_u") == F.size("_v")).select("u", "v", "_u", "_v").mapInArrow(run, "u long, v long")


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a symmetric link matrix that others lead to, the first row of its component and itself."""
    left, first, member = link.sum(1) > 1, [], []
    for i in range(len(link)):
        if not left[i]:
            continue
        left[i], front = False, np.array([i])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & left)
            left[front] = False
            first.append(np.full(len(front), i))
            member.append(front)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *member])


def _join_in_blocks(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)`` that join whatever pairs of a bucket's members with a cosine of at least ``threshold`` join. ``members``
    has ``(key, node, _size)``. All pairs are compared, two blocks at a time; a group hands on less than a row a member."""
    rows = block_pairs(members.join(vectors, "node").withColumn("_dim", F.size("v")), "key", "_size", "node", BLOCK // 2)
    key = ["key", "_dim", "_i", "_j"]
    rows = rows.select(*key, "node", "v").repartition(*key).sortWithinPartitions(*key, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 4):
            nodes, x = group.column("node").to_numpy(), _units(group.column("v"))
            first, member = _forest(np.concatenate([_linked(x[i : i + TILE], x, threshold) for i in range(0, len(x), TILE)]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[first]), pa.array(nodes[member])], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def _split(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``(key, node, _size)`` with every bucket of more than BLOCK members split by further projections, LEVELS times."""
    done, left = [], members
    for level in range(LEVELS):
        done.append(left.filter(F.col("_size") <= BLOCK))
        large = left.filter(F.col("_size") > BLOCK).select("key", "node").join(parts, "node")
        large = large.select("node", "key", F.posexplode(F.slice("parts", level * SPLITS + 1, SPLITS)).alias("_at", "_part"))
        large = staged(large.select(F.xxhash64("key", "_at", "_part").alias("key"), "node"), "split")
        left = staged(large.join(large.groupBy("key").agg(F.count("*").alias("_size")).filter("_size > 1"), "key"), "split-buckets")
    for part in done:
        left = left.unionByName(part)
    return left


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """``(node, n)``: over all vectors of a node's component with a cosine of at least ``threshold``, itself included, the
    number of rows. ``members`` has ``(component, node, v, copies)``. Components are compared block by block, a pair of
    blocks in a group, so that none has to fit into a task; only sums leave a group. A row of a component of m different
    vectors is copied m / BLOCK times, once up to BLOCK; a group multiplies matrices for a second or less."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    rows = members.join(sizes, "component").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("component", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "node", "copies", "v")
    key = ["component", "_i", "_j"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "_side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            nodes, copies, x, out = group.column("node").to_numpy(), group.column("copies").to_numpy(), _units(group.column("v")), np.zeros(group.num_rows, np.int64)
            m = int((group.column("_side").to_numpy() == 0).sum())
            same = group.column("_i")[0] == group.column("_j")[0]
            for i in range(0, m, TILE):
                own = slice(i, min(i + TILE, m))
                if same:
                    out[own] = _linked(x[own], x, threshold) @ copies
                else:
                    link = _linked(x[own], x[m:], threshold)
                    out[own] = link @ copies[m:]
                    out[m:] += copies[own] @ link
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(out)], names=["node", "n"])

    return rows.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.9, tables: int = TABLES, seed: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors are one node. Normalised vectors are hashed by ``tables`` sets of quantised random projections; every
    pair of a bucket is checked by its cosine, in small buckets by a join, in others as matrices; a bucket too large for
    one is split by further projections. Links are then counted by cosine within each component, block by block.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("_ok", usable(F.col("v")) & F.col("vec_id").isNotNull())
    good = rows.filter("_ok").withColumn("_h", F.xxhash64("v"))
    same = good.groupBy("_h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = staged(same, "vectors")
    vectors = nodes.select("node", "v")

    hashed = staged(_hashed(vectors, tables, seed), "hashed")
    keyed = hashed.select("node", "bits", F.explode("keys").alias("key"))
    buckets = staged(keyed.groupBy("key").agg(F.count("*").alias("_size")).filter("_size > 1"), "buckets")
    bucketed = staged(keyed.join(buckets, "key"), "bucketed")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("_bits")))
    small = bucketed.filter(F.col("_size") <= SMALL).select("key", "node", "bits")
    other = small.select("key", F.col("node").alias("_node"), F.col("bits").alias("_bits"))
    pairs = small.join(other, "key").filter((F.col("node") < F.col("_node")) & (apart <= APART)).select(F.col("node").alias("u"), F.col("_node").alias("v"))
    asked = staged(pairs.distinct(), "pairs")
    large = _split(bucketed.filter(F.col("_size") > SMALL).select("key", "node", "_size"), hashed.select("node", "parts"))
    links = _near(asked, vectors, threshold).unionByName(_join_in_blocks(large, vectors, threshold))

    classes = staged(connected_components(links), "components")
    members = nodes.join(classes, "node").select("component", "node", "v", "copies")
    counts = _count_links(members, threshold)
    found = nodes.join(classes, "node", "left").join(counts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("n", "copies") - 1).alias("n"))
    named = good.select("vec_id", "_h", "v").join(nodes.select("_h", "v", "node"), ["_h", "v"]).select("vec_id", "node").join(found, "node")
    named = named.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.filter("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


TREES, BITS = 40, 48
#: Rows of a shard of the forest, and queries that one task puts to it: up to QUERIES of them, every shard is built once.
SHARD, QUERIES = 20_000, 20_000


def _exponents(x: np.ndarray) -> np.ndarray:
    """Of each row the power of two that is just above its largest component."""
    return np.frexp(np.abs(x).max(1, initial=0.0))[1]


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, however large or small: squares are taken of differences over a power of two, which
    changes no digit of those that neither overflow nor vanish."""
    apart = x - query
    by = _exponents(apart)
    by = np.where(np.abs(by) < 400, 0, by)
    return np.ldexp(np.sqrt((np.ldexp(apart, -by[:, None]) ** 2).sum(1)), by)


class PrefixForest:
    """Sorted arrays of ``BITS``-bit hash strings, one a tree, over the rows of one shard."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        self.x, self.trees = x, trees
        self.planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], trees * BITS))
        strings = np.ascontiguousarray(self.strings(x).T)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)
        # the same rows over one power of two, for a first look without overflow
        by = int(_exponents(x).max()) if len(x) else 0
        self.by = by if abs(by) >= 400 else 0
        self.near = np.ldexp(x, -self.by) if self.by else x
        self.squares = (self.near * self.near).sum(1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        by = _exponents(x)  # signs don't depend on it
        x = x if (np.abs(by) < 400).all() else np.ldexp(x, -by[:, None])
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        out = np.empty((len(x), self.trees), np.uint64)
        for i in range(0, len(x), 2048):
            signs = (x[i : i + 2048] @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[i : i + 2048] = (signs * weights).sum(2, dtype=np.uint64)
        return out

    def _ranges(self, query: np.ndarray, bits: int) -> list[tuple[int, int]]:
        """Where each tree's rows share a prefix of ``bits`` with the query."""
        shift = np.uint64(BITS - bits)
        low = (query >> shift) << shift
        high = low + (np.uint64(1) << shift)
        return [tuple(np.searchsorted(own, (a, b))) for own, a, b in zip(self.sorted, low, high, strict=True)]

    def candidates(self, query: np.ndarray, most: int) -> np.ndarray:
        """Descends in all trees to the longest matching prefix, then ascends in all of them together, a bit at a time,
        until the rows that share the prefix in some tree number ``most`` at least. Levels whose ranges are too short for
        that even without overlap are left out by bisection: a shorter prefix never has fewer rows."""
        low, high = 0, BITS
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(b - a for a, b in self._ranges(query, middle)) >= most else (low, middle - 1)
        found = np.zeros(len(self.x), bool)
        for bits in range(low, -1, -1):
            for own, (a, b) in zip(self.order, self._ranges(query, bits), strict=True):
                found[own[a:b]] = True
            if found.sum() >= most:
                break
        return np.flatnonzero(found)


    def nearest_of(self, found: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
        """Which of the rows may be among the ``k`` nearest; the bound keeps all ties of the k-th. All of them where the
        query is of another size than the rows."""
        if int(_exponents(query[None])[0]) - self.by > 400:
            return np.ones(len(found), bool)
        query = np.ldexp(query, -self.by) if self.by else query
        rough = self.squares[found] - 2 * (self.near[found] @ query)
        bound = np.partition(rough, k - 1)[k - 1]
        return rough <= bound + 1e-9 * (1 + abs(bound) + query @ query)


def nearest_neighbours(queries: DataFrame, table: DataFrame, k: int = 10, share: float = 0.5, least: int = 1000, trees: int = TREES, seed: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found by Euclidean distance for each query.

    Every row is indexed, in shards of about SHARD rows dealt by hash; every query is put to every shard once, and the
    shards' best are ranked together. In a shard a query ascends until it has ``share`` of the shard's rows (``least`` at
    least): in high dimension neighbours are hardly nearer than the rest, so the recall wanted sets the share. On vectors
    without clusters the work is therefore linear in the rows for each query.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows, asked = pick(table), pick(queries)
    shards, blocks = max(1, -(-table.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    index = rows.select(F.size("v").alias("_dim"), deal(shards, 1).alias("_shard"), every(blocks).alias("_block"), F.lit(0).alias("_side"), "id", "v")
    asked = asked.select(F.size("v").alias("_dim"), every(shards).alias("_shard"), deal(blocks, 2).alias("_block"), F.lit(1).alias("_side"), "id", "v")
    key = ["_dim", "_shard", "_block"]
    both = index.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "_side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, parts, forest = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)], 1)
            bounds = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own, side = tuple(keys[a, :3]), keys[a, 3]
                x = np.asarray(batch.column(5).slice(a, b - a).flatten(), float).reshape(b - a, -1)
                names = np.asarray(batch.column(4).slice(a, b - a))
                if own != last:
                    last, ids, parts, forest = own, [], [], None
                if side == 0:
                    ids.append(names)
                    parts.append(x)
                    continue
                if not parts:
                    continue
                if forest is None:
                    forest, known = PrefixForest(np.concatenate(parts), trees, seed), np.concatenate(ids)
                out = []
                most = max(least, int(np.ceil(share * len(known))))
                for name, query, strings in zip(names, x, forest.strings(x), strict=True):
                    found = forest.candidates(strings, most)
                    found = found[known[found] != name]
                    if len(found) > k:
                        found = found[forest.nearest_of(found, query, k)]
                    score = distances(forest.x[found], query)
                    best = np.lexsort((known[found], score))[:k]
                    out += zip([name] * len(best), known[found][best], score[best], strict=True)
                q, v, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q, np.int64)), pa.array(np.array(v, np.int64)), pa.array(np.array(s, float))], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
