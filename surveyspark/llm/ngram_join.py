"""N-gram Jaccard join: exact links between documents, and their connected components.

The product of the document by n-gram incidence with its transpose, in two blocked steps.

1. Documents with equal n-gram sets become one row (a *node*).  Columns are first taken a block of
   n-grams at a time.  Two sets that link differ in at most H n-grams, where H follows from the sizes;
   if the n-grams are dealt to 2H + 2 blocks by hash, at most H of a set's blocks differ from the other
   set's.  With blocks ordered by rarity, it is enough to look at the H + 1 rarest of each set.  So pairs
   without an equal one among these have too small an overlap and are never made.
2. For the pairs left, overlap counts are added up over ranges of n-grams, and a pair is dropped as
   soon as its count plus what is left of the smaller set is below the bound of its two sizes.

An n-gram that no other node in the product has cannot be in any overlap, so a pair's overlap is at most
the smaller count of n-grams that others have too; pairs below the bound even then are never made, which
leaves out the many near copies of one text that differ too much from each other.

Documents that share a passage do not meet in a block, since a block holds other n-grams too; near
copies do, and within a block they are tried against one leader first, the node with the smallest share
of n-grams of its own.  Pairs that the links found so far already connect need no test.  The others are
compared by their differences from one head of all nodes connected by blocks: two that link have enough
differences in common that the rarest ones of each meet (``family_differences``), so no link between
components is lost, and the many near copies of one text are not paired by what they all share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm import text as tx
from surveyspark.llm.components import connected_components
from surveyspark.runtime import materialise

SIZE = 4
PERCENT = 85
# Ranges of n-grams over which overlaps are added up.
RANGES = 8


class Levels:
    """Size classes such that sets that link are in one class or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def cover(self, largest: int) -> None:
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * 100 // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.cover(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def differing(self, level: int) -> int:
        """The most n-grams in which two linked sets of this level, or of this and the next, differ."""
        self.cover(self.low[-1])
        a = self.low[level + 1] - 1
        b = a * 100 // self.percent
        return (a + b) * (100 - self.percent) // (100 + self.percent)


def blocks_of(differing: int) -> int:
    """Blocks of n-grams: twice as many as can differ, so that half of them need not be looked at."""
    return 2 * (differing + 1)


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) entries in that order."""
    words = tx.Words(tx.lower(data), offsets, tx.NOT_SPACE)
    code, doc = tx.shingles(words, words.hashes(), size)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return code[new], doc[new]


def set_hashes(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set; the first names the node."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(tx.mix(code ^ np.uint64(salt)), out=total[1:])
        out.append(tx.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def document_sets(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_shingles, node and check of each row; rows without words have no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch, data, offsets in tx.chunks(batches, "_bytes"):
                code, doc = sets_of(data, offsets, size)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                n = np.diff(first)
                node, check = (x.view(np.int64) for x in set_hashes(code, first))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(keep))]
                    + [pa.array(n), pa.array(node, mask=none), pa.array(check, mask=none)],
                    names=[*keep, "n_shingles", "node", "check"])
        yield from tx.gathered(each())

    source = docs.select(*keep, tx.utf8().alias("_bytes"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, f"{kinds}, n_shingles bigint, node bigint, check bigint")


def block_entries(code: np.ndarray, first: np.ndarray, node: np.ndarray, percent: int
                  ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block content hash, node, set size, spare) of every block of every document.

    A linked set shares all but ``differing`` of the filled blocks, so a document may leave out all but its
    ``differing + 1`` rarest ones: ``spare`` of them, doubled, plus one bit for the size class.
    """
    levels = Levels(percent)
    n = np.diff(first)
    level = levels.of(np.maximum(n, 1))
    high = code >> np.uint64(32)
    value = tx.mix(code ^ np.uint64(0xB10C))
    for lower in (0, 1):
        at = level - lower
        kinds = {int(g): levels.differing(int(g)) for g in np.unique(at[n > 0]) if g >= 0}
        differing = np.array([kinds.get(int(g), 0) for g in at], np.int64)
        # Sets that differ in nothing are one node already.
        active = (n > 0) & (at >= 0) & (differing > 0)
        if not active.any():
            continue
        blocks = np.where(active, [blocks_of(d) for d in differing.tolist()], 0)
        base = np.concatenate([[0], np.cumsum(blocks)])
        use = np.repeat(active, n)
        cell = (np.repeat(base[:-1], n)[use]
                + (high[use] * np.repeat(blocks, n)[use].astype(np.uint64) >> np.uint64(32)).astype(np.int64))
        # Within a document codes ascend, so cells do: sums are differences of running sums.
        total = np.zeros(len(cell) + 1, np.uint64)
        np.cumsum(value[use], out=total[1:])
        edge = np.searchsorted(cell, np.arange(base[-1] + 1))
        content = total[edge[1:]] - total[edge[:-1]]
        filled = edge[1:] > edge[:-1]
        owner = np.repeat(np.arange(len(n)), blocks)
        number = np.arange(base[-1]) - base[owner]
        held = np.bincount(owner[filled], minlength=len(n))
        enough = held > differing
        spare = np.where(enough, held - differing - 1, 0) * 2 + (at & 1)
        keep = filled | ~enough[owner]
        owner, number, content = owner[keep], number[keep], content[keep]
        salt = tx.mix((at[owner] * 1_000_003 + number).astype(np.uint64))
        yield tx.mix(content ^ salt), node[owner], n[owner], spare[owner]


def shared_blocks(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(block, node, n, spare, nodes): the blocks that several nodes have, and how many have them."""
    buckets = tx.n_buckets(docs)
    names = ["block", "node", "n", "spare"]
    schema = tx.Blobs(buckets, names).schema()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = tx.Blobs(buckets, names)
        for _, data, offsets in tx.chunks(batches, "_bytes"):
            code, doc = sets_of(data, offsets, size)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            node, _ = set_hashes(code, first)
            for block, owner, n, spare in block_entries(code, first, node, percent):
                blobs.add(tx.bucket_of(block, buckets), block, owner, n.astype(np.int32), spare.astype(np.int32))
            if blobs.full():
                yield blobs.take()
        if (rest := blobs.take()) is not None:
            yield rest

    def meet(table: pa.Table) -> pa.Table:
        block, node = tx.unpack(table, "block", np.uint64), tx.unpack(table, "node", np.uint64)
        n, spare = tx.unpack(table, "n", np.int32), tx.unpack(table, "spare", np.int32)
        order = np.argsort(block)
        block = block[order]
        same = block[1:] == block[:-1]
        twin = np.zeros(len(block), bool)
        twin[1:] |= same
        twin[:-1] |= same
        block, order = block[twin], order[twin]
        node, n, spare = node[order], n[order], spare[order]
        order = np.lexsort((node, block))
        block, node, n, spare = block[order], node[order], n[order], spare[order]
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (node[1:] != node[:-1])
        block, node, n, spare = block[new], node[new], n[new], spare[new]
        _, inverse, count = np.unique(block, return_inverse=True, return_counts=True)
        several = count[inverse] > 1 if len(block) else np.zeros(0, bool)
        return pa.table({"block": block[several].view(np.int64), "node": node[several].view(np.int64),
                         "n": n[several], "spare": spare[several],
                         "nodes": count[inverse][several].astype(np.int64) if len(block) else np.zeros(0, np.int64)})

    return (docs.select(tx.utf8().alias("_bytes")).mapInArrow(emit, schema)
            .groupBy("bucket").applyInArrow(meet, "block bigint, node bigint, n int, spare int, nodes bigint"))


def needed_blocks(shared: DataFrame) -> DataFrame:
    """(block, node, n): each node's rarest blocks, enough for every link; what only one node is left with goes.

    Blocks have one order, by how many nodes have them.  Two linked nodes share more blocks than either leaves
    out, so the rarest block that they share is kept by both.
    """
    frequent = Window.partitionBy("node", F.col("spare") % 2).orderBy(F.desc("nodes"), F.desc("block"))
    kept = materialise(shared.withColumn("place", F.row_number().over(frequent))
                       .filter("place > floor(spare / 2)").select("block", "node", "n"))
    several = kept.groupBy("block").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y")
    return kept.join(several.select("block"), "block", "left_semi")


def overlap_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: overlaps added up range by range, with early discards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            links = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                links[i] = linked(x, y, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(run, "a bigint, b bigint"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets link."""
    # 100 * overlap >= percent * union, as a bound on the overlap alone.
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need:
        return False
    cuts = np.array([(i << 64) // RANGES for i in range(1, RANGES)], np.uint64)
    ex = np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]])
    ey = np.concatenate([[0], np.searchsorted(y, cuts), [len(y)]])
    overlap = 0
    for i in range(RANGES):
        overlap += len(np.intersect1d(x[ex[i]:ex[i + 1]], y[ey[i]:ey[i + 1]], assume_unique=True))
        if overlap + min(len(x) - ex[i + 1], len(y) - ey[i + 1]) < need:
            return False
    return overlap >= need


def common_counts(sets: DataFrame) -> DataFrame:
    """(node, common): how many of a node's n-grams another node has, too.

    A bucket of n-grams counts for the nodes in it; counts travel packed, one row for each bucket of n-grams and of nodes.
    """
    buckets = tx.n_buckets(sets)
    node_buckets = max(1, buckets // 3)
    counts = tx.Blobs(node_buckets, ["node", "common"]).schema()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = tx.Blobs(buckets, ["code", "node"])
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                codes = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in codes])
                code = np.concatenate(codes)
                blobs.add(tx.bucket_of(code, buckets), code, node)
                if blobs.full():
                    yield blobs.take()
        if (rest := blobs.take()) is not None:
            yield rest

    def meet(table: pa.Table) -> pa.Table:
        code, node = tx.unpack(table, "code", np.uint64), tx.unpack(table, "node", np.int64)
        order = np.argsort(code)
        code, node = code[order], node[order]
        same = code[1:] == code[:-1]
        twin = np.zeros(len(code), bool)
        twin[1:] |= same
        twin[:-1] |= same
        nodes, count = np.unique(node[twin], return_counts=True)
        blobs = tx.Blobs(node_buckets, ["node", "common"])
        blobs.add(tx.bucket_of(tx.mix(nodes.view(np.uint64)), node_buckets), nodes, count.astype(np.int32))
        packed = blobs.take()
        return pa.Table.from_batches([packed]) if packed is not None else pa.table(
            {"bucket": pa.array([], pa.int32()), "node": pa.array([], pa.binary()), "common": pa.array([], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        node, common = tx.unpack(table, "node", np.int64), tx.unpack(table, "common", np.int32)
        nodes, place = np.unique(node, return_inverse=True)
        return pa.table({"node": nodes, "common": np.bincount(place, common, len(nodes)).astype(np.int64)})

    return (sets.select("node", "set").mapInArrow(emit, tx.Blobs(buckets, ["code", "node"]).schema())
            .groupBy("bucket").applyInArrow(meet, counts)
            .groupBy("bucket").applyInArrow(add, "node bigint, common bigint"))


def node_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set) of the wanted nodes; ``wanted`` names one row of each by doc_id and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for _, data, offsets in tx.chunks(batches, "_bytes"):
                code, doc = sets_of(data, offsets, size)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                node, _ = set_hashes(code, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)),
                     pa.array([code[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())],
                    names=["node", "set"])
        yield from tx.gathered(each(), 500)

    source = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"),
                         F.xxhash64("text").alias("row_hash"), tx.utf8().alias("_bytes"))
    return (source.join(wanted.hint("shuffle_hash"), ["row_id", "row_hash"], "left_semi").select("_bytes")
            .mapInArrow(run, "node bigint, set binary").dropDuplicates(["node"]))


def family_differences(state: DataFrame, leader: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """One row of each node: its family, the family's head, the n-grams in which the two differ, and ``need``.

    A family holds all nodes connected by blocks; its head leads most of them.  ``near`` nodes link with the head.
    With s = |x| + |y|, two sets link if (100 + percent) * |x ^ y| <= (100 - percent) * s, and |x ^ y| is
    |dx| + |dy| - 2 |dx & dy| for the differences dx and dy from the head.  Near nodes are all connected, so of two
    nodes not connected one at least, y, is not near.  Then

    * if x is near, |dx & dy| > (|dx| + (100 - percent) / (100 + percent) * (|head| - |x|)) / 2, whatever y is;
    * |dx & dy| >= |dy| - |x ^ y| >= |dy| - (100 - percent) / percent * |y|, whatever x is, and at least 1.

    So it is enough that the ``need`` rarest differences of two nodes have one in common.
    """
    led = state.select("block", "node").join(leader.select("block", F.col("node").alias("first")), "block")
    edges = led.filter("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    families = connected_components(materialise(edges.distinct())).select("node", F.col("component").alias("family"))
    heads = (led.groupBy("first").agg(F.count(F.lit(1)).alias("rows"))
             .join(families.withColumnRenamed("node", "first"), "first").groupBy("family")
             .agg(F.max(F.struct("rows", "first")).alias("top")).select("family", F.col("top.first").alias("head")))
    heads = heads.join(sets.select(F.col("node").alias("head"), F.col("set").alias("head_set")), "head")
    nodes = state.select("node", "n", "common").distinct().join(families, "node").join(sets, "node").join(heads, "family")
    left, total = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, need, found = [], [], []
            for one, other in zip(batch.column(5), batch.column(6)):
                x, head = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                differ = np.setxor1d(x, head, assume_unique=True)
                d, n = len(differ), len(x)
                near.append(total * d <= left * (n + len(head)))
                shared = (total * d + left * (len(head) - n)) // (2 * total) + 1 if near[-1] else d - left * n // percent
                need.append(d - max(shared, 1) + 1)
                found.append(differ.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)]
                + [pa.array(near, pa.bool_()), pa.array(need, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["family", "head", "node", "n", "common", "near", "need", "differ"])

    return nodes.select("family", "head", "node", "n", "common", "set", "head_set").mapInArrow(
        run, "family bigint, head bigint, node bigint, n int, common bigint, near boolean, need int, differ array<bigint>")


def rarest_differences(apart: DataFrame) -> DataFrame:
    """(family, code, node, n, common, component): the ``need`` rarest differences of each node, by how many of the family have them."""
    codes = apart.select("family", "node", "n", "common", "component", "need", F.explode("differ").alias("code"))
    known = codes.groupBy("family", "code").agg(F.count(F.lit(1)).alias("nodes"))
    rare = Window.partitionBy("node").orderBy("nodes", "code")
    return (codes.join(known, ["family", "code"]).withColumn("place", F.row_number().over(rare))
            .filter("place <= need and nodes > 1").select("family", "code", "node", "n", "common", "component"))


def linked_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, components): doc_id, n_shingles and node of each row, and the component of linked nodes."""
    docs = docs.select("doc_id", "text")
    rows = materialise(document_sets(
        docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")), size, ["doc_id", "row_hash"]))
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"), "row_hash")).alias("row"),
        F.min("check").alias("low"), F.max("check").alias("high"))
    blocks = materialise(needed_blocks(shared_blocks(docs, size, percent)))
    in_blocks = blocks.select("node").distinct()
    wanted = nodes.join(in_blocks, "node").select("node", "row.*", "low", "high")
    wanted = materialise(wanted)
    if wanted.filter("low <> high").limit(1).count():
        raise RuntimeError("Two different n-gram sets have one 64-bit hash; change the salts of set_hashes.")
    sets = materialise(node_sets(docs, wanted.select("row_id", "row_hash"), size))

    # Nodes too many of whose n-grams are their own can link with nothing.
    state = materialise(blocks.join(common_counts(sets), "node").filter(100 * F.col("common") >= percent * F.col("n"))
                        .withColumn("component", F.col("node")))
    alive = state

    def within(x: str, y: str):
        """Whether the overlap may still reach the bound of the two sizes."""
        most = F.least(f"{x}.common", f"{y}.common")
        return 100 * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - most)

    def pair(x: str, y: str) -> list:
        return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]

    leader = (alive.groupBy("block").agg(F.min(F.struct((1 - F.col("common") / F.col("n")).alias("own"), "node", "n", "common"))
                                         .alias("y")).select("block", "y.*"))
    x, y = alive.alias("x"), leader.alias("y")
    first = materialise(x.join(y, F.col("x.block") == F.col("y.block"))
                        .filter((F.col("x.node") != F.col("y.node")) & within("x", "y")).select(*pair("x", "y")).distinct())
    links = materialise(overlap_links(first, sets, percent))
    components = connected_components(links)
    state = (alive.drop("component").join(components, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    # Only blocks whose nodes are not connected yet need another look.
    open_blocks = state.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    state = materialise(state.join(open_blocks.select("block"), "block", "left_semi"))
    apart = materialise(family_differences(state, leader, sets, percent))
    near = apart.filter("near and node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    components = connected_components(stars.unionByName(near))
    left = materialise(rarest_differences(apart.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))))
    x, y = left.alias("x"), left.alias("y")
    others = materialise(x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.code") == F.col("y.code"))
                                & (F.col("x.component") < F.col("y.component")) & within("x", "y"))
                         .select(*pair("x", "y")).distinct().join(first, ["a", "b"], "left_anti"))
    more = materialise(overlap_links(others, sets, percent))
    if more.limit(1).count():
        stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = connected_components(stars.unionByName(more))
    return rows, components


def component_ids(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text; other columns are ignored).

    A NULL or wordless text has no shingles and is a component of its own.  Rows with equal shingle
    sets are linked, also if they repeat a doc_id.  A NULL doc_id is never the smallest of a component
    unless all its members have none.  An empty table gives no rows.
    """
    rows, components = linked_classes(docs, size, percent)
    placed = (rows.join(components, "node", "left")
              .select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("component")))
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (placed.join(least, "component", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the smallest doc_id, of rows that repeat it the smallest text hash.

    NULL, empty and other wordless texts stay; rows that repeat both doc_id and text are one row, with the other columns of any of
    them.  Other columns stay, whatever their names.  An empty table gives no rows.
    """
    rows, components = linked_classes(docs, size, percent)
    placed = (rows.filter("node is not null").join(components, "node", "left")
              .select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), "doc_id", "row_hash",
                      F.coalesce("component", "node").alias("component")))
    chosen = (placed.groupBy("component").agg(F.min(F.struct("order", "row_hash", "doc_id")).alias("row"))
              .select("row.doc_id", "row.row_hash")
              .unionByName(rows.filter("node is null").select("doc_id", "row_hash").distinct())
              .select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"), "row_hash"))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"),
                          F.xxhash64("text").alias("row_hash"))
    kept = carried.join(chosen, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
