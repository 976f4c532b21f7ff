"""Prefix tries of conversations by a splitter skeleton.

A conversation's path is its turns' digests one after another, so paths sort by turns and conversations that begin alike
stand together. The paths are dealt out by splitters, paths of a sample, into ranges. The trie of the splitter paths, the
skeleton, is broadcast: a node outside it has all its members in one range, so the range's shard finishes it alone, sorted,
with one stack of open nodes. Nodes of the skeleton may have members in several ranges: shards give partial aggregates,
which are summed by node and then over subtrees.

A splitter is a path and a conversation id, so the copies of a frequent conversation are dealt out over several shards.
Splitters reach the driver and the shards: at most ``SPLITTER_BYTES`` together, longer paths are cut, which moves the
ranges' ends but no result. The sample decides nothing but where the ranges end. A shard holds the closed children of its
open nodes; a path (16 bytes a turn) must fit into memory, as must a shard's share of ``TURNS_A_SHARD`` turns.

Defined results: turns of a conversation are ordered by turn, null first, then role and text; null role or text is empty;
repeated rows are several turns; rows without a ``conv_id`` belong to no conversation; a table without conversations gives
no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevanta.llm.common import staged

#: Bytes of a turn's digest in a path.
SYMBOL = 16
SPLITTER_BYTES = 32 << 20
TURNS_A_SHARD = 2_000_000
#: Candidates for splitters by shard.
SAMPLED = 40
#: Decimal ids of a skeleton node's ends travel in pieces of about so many characters.
PIECE_CHARS = 16_384


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path BINARY, sizes ARRAY<BIGINT>``: a digest and the text's UTF-8 bytes for each turn, in order."""
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text"))
    digest = F.substr(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256), F.lit(1), F.lit(2 * SYMBOL))
    rows = rows.select("conv_id", F.struct(place.alias("n"), digest.alias("d"), F.octet_length("_text").cast("long").alias("b")).alias("_t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("_t", lambda x: x["d"]), "")).alias("path"), F.transform("_t", lambda x: x["b"]).alias("sizes"))


def rebuilt(paths: DataFrame, base: Column, head: Column) -> DataFrame:
    """Conversations whose first ``head`` turns are those of conversation ``base`` (none if there is none); both are
    columns of ``conv_id``. A turn beyond the head stays where the conversation has it."""
    own = paths.withColumns({"_base": base, "_h": head.cast("int")})
    heads = paths.select(F.col("conv_id").alias("_base"), F.col("path").alias("_path"), F.col("sizes").alias("_sizes"))
    heads = heads.join(own.select("_base").distinct(), "_base", "left_semi")
    none = F.array().cast("array<bigint>")
    cut = lambda path, start, length: F.substr(path, start, length)
    joined = own.join(heads, "_base", "left")
    path = F.concat(cut(F.coalesce("_path", F.lit(b"")), F.lit(1), F.col("_h") * SYMBOL), cut(F.col("path"), F.col("_h") * SYMBOL + 1, F.greatest(F.octet_length("path") - F.col("_h") * SYMBOL, F.lit(0))))
    sizes = F.concat(F.slice(F.coalesce("_sizes", none), F.lit(1), F.col("_h")), F.slice("sizes", F.col("_h") + 1, F.greatest(F.size("sizes") - F.col("_h"), F.lit(0))))
    return joined.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Symbols that two paths share at their beginning."""
    n = min(len(a), len(b)) // SYMBOL
    if a[: n * SYMBOL] == b[: n * SYMBOL]:
        return n
    low, high = 0, n - 1  # the first `low` are shared, not more than `high`
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * SYMBOL] == b[: mid * SYMBOL]:
            low = mid
        else:
            high = mid - 1
    return low


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 pairs of path and id, ascending, that cut the rows into ranges of about equal turns."""
    rows = paths.count()
    if not rows or shards < 2:
        return []
    at_most = max(1, SPLITTER_BYTES // shards // SYMBOL) * SYMBOL
    h = F.xxhash64("conv_id", F.lit(13)).cast("double") / F.lit(2.0**64) + 0.5
    sample = paths.filter(h <= min(1.0, SAMPLED * shards / rows)).select(F.substr("path", F.lit(1), F.lit(at_most)).alias("path"), "conv_id", (F.size("sizes") + 1).alias("_w"))
    order = Window.orderBy("path", "conv_id")  # SAMPLED rows a shard
    placed = sample.withColumns({"_before": F.sum("_w").over(order) - F.col("_w"), "_all": F.sum("_w").over(Window.partitionBy())})
    part = lambda c: F.floor(c * shards / F.col("_all"))
    cuts = placed.filter(part(F.col("_before") + F.col("_w")) > part(F.col("_before"))).select("path", "conv_id").orderBy("path", "conv_id").limit(shards)
    return sorted({(bytes(r["path"]), r["conv_id"]) for r in cuts.collect()})[: shards - 1]


class Skeleton:
    """The trie of the splitter paths. Nodes are numbered in preorder; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.end, self.paths = [-1], [0], [0], []
        stack, last = [0], b""
        for path, _ in splitters:
            keep = _common(last, path)
            for n in stack[keep + 1 :]:
                self.end[n] = len(self.parent)
            del stack[keep + 1 :]
            for d in range(keep + 1, len(path) // SYMBOL + 1):
                stack.append(len(self.parent))
                self.parent.append(stack[-2])
                self.depth.append(d)
                self.end.append(0)
            self.paths.append(np.array(stack, np.int32))
            last = path
        for n in stack:
            self.end[n] = len(self.parent)

    def nodes_on(self, path: bytes) -> np.ndarray:
        """Numbers of the skeleton's nodes on a path, from the root down: its neighbours among the splitters share most."""
        at = bisect.bisect_left(self.splitters, (path, -(1 << 63)))
        best, found = 0, np.zeros(1, np.int32)
        for i in (at - 1, at):
            if 0 <= i < len(self.splitters) and (n := _common(self.splitters[i][0], path)) >= best:
                best, found = n, self.paths[i][: n + 1]
        return found


_OUT = "kind string, node int, parent int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends string, piece long"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


class _Open:
    __slots__ = ("convs", "children", "leaves", "saved", "least", "ends", "hash", "size", "node", "waiting")

    def __init__(self, size: int, node: int):
        self.convs = self.children = self.leaves = self.saved = self.ends = 0
        self.least, self.hash, self.size, self.node, self.waiting = None, None, size, node, []


class _Shard:
    """Builds the nodes of one range from its rows in order."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.out = skeleton, []
        self.open: list[_Open] = []
        self.last, self.piece, self.pieces = None, [], 0

    def add(self, path: bytes, conv: int, sizes) -> None:
        if path != self.last:
            keep = 0 if self.last is None else _common(self.last, path) + 1
            self.close(keep)
            on = self.skeleton.nodes_on(path)
            for d in range(keep, len(path) // SYMBOL + 1):
                self.open.append(_Open(int(sizes[d - 1]) if d else 0, int(on[d]) if d < len(on) else -1))
            self.last = path
        top = self.open[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(conv, top.least)
        text = ("," if top.ends else "") + str(conv)
        top.ends += 1
        if top.node >= 0:
            self.piece.append(text if len(self.piece) else str(conv))
            if len(self.piece) * 8 >= PIECE_CHARS:
                self.cut(top.node)
        else:
            top.hash = top.hash or hashlib.sha256()
            top.hash.update(text.encode())

    def cut(self, node: int) -> None:
        if self.piece:
            self.row(kind="ends", node=node, ends="".join(self.piece), piece=self.pieces)
            self.piece, self.pieces = [], self.pieces + 1

    def close(self, keep: int) -> None:
        if self.open and self.open[-1].node >= 0:
            self.cut(self.open[-1].node)
        while len(self.open) > keep:
            top = self.open.pop()
            below = self.open[-1] if self.open else None
            if below is not None:
                below.convs += top.convs
                below.least = top.least if below.least is None else min(below.least, top.least)
            if top.node >= 0:
                self.row(kind="part", node=top.node, conv_id=top.least, n_convs=top.convs, n_children=top.children, n_leaves=top.leaves, saved=top.saved, bytes=top.size)
                continue  # its children went out at once, with its number
            top.leaves = top.leaves or 1
            top.saved += (top.convs - 1) * top.size
            below.children += 1
            below.leaves += top.leaves
            below.saved += top.saved
            for child in top.waiting:
                child[_PARENT] = top.least
                self.out.append(child)
            row = self.made(kind="node", conv_id=top.least, depth=len(self.open), n_convs=top.convs, n_children=top.children, n_leaves=top.leaves, saved=top.saved, ends=(top.hash or hashlib.sha256()).hexdigest())
            if below.node >= 0:
                row[_NODE] = below.node
                self.out.append(row)
            else:
                below.waiting.append(row)

    def made(self, **values) -> list:
        return [values.get(n) for n in _NAMES]

    def row(self, **values) -> None:
        self.out.append(self.made(**values))


_PARENT, _NODE = _NAMES.index("parent_conv_id"), _NAMES.index("parent")


def _shard_ids(paths: DataFrame, skeleton) -> DataFrame:
    """``paths`` with ``shard``, the number of splitters that are not above the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = skeleton.value.splitters
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32()))

    return paths.select("conv_id", "path", "sizes").mapInArrow(run, "conv_id long, path binary, sizes array<bigint>, shard int")


def _local(rows: DataFrame, skeleton) -> DataFrame:
    """Finished nodes, partial aggregates and pieces of ends of each shard's sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (f.split() for f in _OUT.split(", "))])

        def taken(state: _Shard, all_: bool) -> Iterator[pa.RecordBatch]:
            while len(state.out) >= 20_000 or (all_ and state.out):
                some, state.out = state.out[:20_000], state.out[20_000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

        state, shard = _Shard(skeleton.value), None
        for batch in batches:
            offsets, sizes = batch.column("sizes").offsets.to_numpy(), batch.column("sizes").values.to_numpy(zero_copy_only=False)
            for i, (s, path, conv) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)):
                if s != shard:
                    state.close(0)
                    yield from taken(state, True)
                    state, shard = _Shard(skeleton.value), s
                    state.pieces = s << 32
                state.add(path, conv, sizes[offsets[i] : offsets[i + 1]])
                if len(state.out) >= 20_000:
                    yield from taken(state, False)
        state.close(0)
        yield from taken(state, True)

    return rows.select("conv_id", "path", "sizes", "shard").mapInArrow(run, _OUT)


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the pieces of each node in order; a task holds one batch of pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != node:
                    if digest is not None:
                        yield give()
                    node, digest = n, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if digest is not None:
            yield give()

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ends").mapInArrow(run, "node int, ends_sha256 string")


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a node of the trie of ``paths(conv_id, path, sizes)``: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``, as the contract names them. Conversation ids don't repeat."""
    spark = paths.sparkSession
    paths = staged(paths, "trie-paths")
    if shards is None:
        turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_A_SHARD))
    skeleton = Skeleton(choose_splitters(paths, shards))
    known = spark.sparkContext.broadcast(skeleton)
    ranges = len(skeleton.splitters) + 1
    dealt = _shard_ids(paths, known).repartitionById(ranges, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    built = staged(_local(dealt, known), "trie-shards")

    # the skeleton: sums by node, then sums over subtrees, which are intervals of preorder numbers
    tree = spark.createDataFrame(pa.table({"node": pa.array(range(len(skeleton.parent)), pa.int32()), "parent": pa.array(skeleton.parent, pa.int32()), "depth": pa.array(skeleton.depth, pa.int64()), "end": pa.array(skeleton.end, pa.int32())}))
    sums = built.filter("kind = 'part'").groupBy("node").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("bytes").alias("bytes"))
    nodes = tree.join(sums, "node")  # a splitter's path begins a sampled path, so every node has members
    inner = nodes.filter("parent >= 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_inner"))
    nodes = nodes.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_inner", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")})
    up_to = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a skeleton node
    run_up = staged(nodes.withColumns({"_leaves": F.sum("n_leaves").over(up_to), "_saved": F.sum("saved").over(up_to)}), "trie-skeleton")
    lasts = run_up.select((F.col("node") + 1).alias("end"), F.struct(F.col("_leaves").alias("_le"), F.col("_saved").alias("_sa")).alias("_l"))
    above = run_up.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    skeletal = run_up.join(lasts, "end").withColumns({"n_leaves": F.col("_l._le") - F.col("_leaves") + F.col("n_leaves"), "saved": F.col("_l._sa") - F.col("_saved") + F.col("saved")})
    skeletal = skeletal.join(above, "parent", "left").join(_ends_digests(built.filter("kind = 'ends'")), "node", "left")

    names = [F.col("conv_id"), F.col("depth"), F.col("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"), F.col("saved").alias("saved_tokens")]
    top = skeletal.select(*names, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    # at most as many rows as the skeleton has nodes, 1 / 16 of SPLITTER_BYTES
    local = built.filter("kind = 'node'").join(F.broadcast(above.withColumnRenamed("parent_conv_id", "_above")), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return top.unionByName(local.select(*names, F.col("ends").alias("ends_sha256")))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The contract's rows: conversations whose heads are those of every fifth one."""
    paths = staged(conversation_paths(conversations), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % 5
    return prefix_trie(rebuilt(paths, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9))
