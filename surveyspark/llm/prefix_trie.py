"""The prefix trie of all conversations as a table of nodes, from perfect-hash node tables per shard.

A node is a sequence of first turns.  It is named by a 128-bit digest, the exclusive or of one hash for each
(depth, turn), so digests of all prefixes are running sums and a conversation may be cut anywhere.  Shards are groups of
whole conversations (of pieces of very long ones).  A shard enumerates its distinct digests, gives each a slot of a minimal perfect
hash, verified against the digest kept in that slot, scatters counts into flat arrays, and adds subtree values
up through an array of parent slots, deepest nodes first.

A node that many conversations share, such as a common first turn, is one row in each shard; shards meet only in
sums over digests.  What a node adds to its ancestors is added in one shard alone, that of its smallest
conversation, which also has all its ancestors.  No text is shuffled, only its hash and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.text import mix, utf8
from surveyspark.runtime import materialise

# Rows of a shard on average, and turns of one conversation that stay together.
SHARD_ROWS = 16_384
SEGMENT = 4_096
EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns in order ----------------------------------------------------------------------------------

def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit halves of a hash of (role, text), and the length of the text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, sizes = bytearray(), np.empty(batch.num_rows, np.int64)
        for i, (role, text) in enumerate(zip(batch.column(2), batch.column(3))):
            role, text = role.as_buffer(), text.as_buffer()
            code = hashlib.blake2b(len(role).to_bytes(8, "little"), digest_size=16)
            code.update(role)
            code.update(text)
            codes += code.digest()
            sizes[i] = len(text)
        halves = np.frombuffer(bytes(codes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes)],
            names=["conv_id", "turn", "t1", "t2", "bytes"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers rows of a sorted partition within their conversation."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, np.diff(conv) != 0))
        local = np.arange(1, len(conv) + 1) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if conv[0] == last:
            local[:first[1] if len(first) > 1 else len(conv)] += held
        last, held = conv[-1], local[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(local.astype(np.int64)), *batch.columns[1:]],
            names=["part", "conv_id", "local", "t1", "t2", "bytes"])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, position, t1, t2, bytes) of every turn, and (conv_id, length) of every conversation.

    Positions count from 1 by ``turn``, NULL first; equal turns follow the hash of role and text, so equal rows are turns of
    their own in any order.  NULL roles and texts are empty; rows without conv_id belong to no conversation.  Rows are dealt by
    ranges of (conversation, turn), so one huge conversation is spread over many tasks.
    """
    turns = (conversations.filter(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", utf8("role").alias("role"), utf8("text").alias("text")))
    kind = conversations.schema["turn"].dataType.simpleString()
    hashed = turns.mapInArrow(_hashed, f"conv_id bigint, turn {kind}, t1 bigint, t2 bigint, bytes bigint")
    # The mark only spreads equal rows over several ranges.
    keys = ["conv_id", "turn", "t1", "t2", "mark"]
    ranged = hashed.withColumn("mark", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(ranged.select("conv_id", "t1", "t2", "bytes").mapInArrow(
        _counted, "part int, conv_id bigint, local bigint, t1 bigint, t2 bigint, bytes bigint"))
    counts = rows.groupBy("part", "conv_id").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # At most one conversation reaches into a range from the one before it: no more rows than ranges.
    carried = counts.withColumn("before", before).filter("before > 0").select("part", "conv_id", "before")
    positions = rows.join(F.broadcast(carried), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("position"), "t1", "t2", "bytes")
    return positions, counts.groupBy("conv_id").agg(F.sum("n").alias("length"))


def rebuilt_turns(conversations: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations rebuilt on the head of their family's first one.

    Conversation c becomes the first h turns of conversation c - c % family (all if fewer, none if it is absent), then its own
    turns after its first h; h = crc32 of the decimal c, modulo ``heads``.  A conversation may end up without turns.
    """
    turns, lengths = ordered_turns(conversations)
    turns, lengths = materialise(turns), materialise(lengths)
    base = F.col("conv_id") - F.col("conv_id") % family
    plan = lengths.select("conv_id", "length", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    known = lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plan = (plan.join(known, "base", "left")
            .withColumn("kept", F.least("h", F.coalesce("base_length", F.lit(0))))
            .withColumn("new_length", F.when(F.col("base") == F.col("conv_id"), F.col("length"))
                        .otherwise(F.col("kept") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))))
    plan = materialise(plan.select("conv_id", "base", "h", "kept", "new_length"))
    own = (turns.join(plan, "conv_id").filter((F.col("base") == F.col("conv_id")) | (F.col("position") > F.col("h")))
           .select("conv_id", F.when(F.col("base") == F.col("conv_id"), F.col("position"))
                   .otherwise(F.col("position") - F.col("h") + F.col("kept")).alias("depth"), "t1", "t2", "bytes", "new_length"))
    first = turns.filter(F.col("position") < heads).withColumnRenamed("conv_id", "base")
    taken = (first.join(plan.filter("base != conv_id"), "base").filter("position <= kept")
             .select("conv_id", F.col("position").alias("depth"), "t1", "t2", "bytes", "new_length"))
    rows = own.unionByName(taken).withColumn("last", F.col("depth") == F.col("new_length")).drop("new_length")
    return rows, plan.select("conv_id", F.col("new_length").alias("length"))


# --- node tables of a shard --------------------------------------------------------------------------

class Slots:
    """Minimal perfect hash of distinct digests; ``find`` checks the digest in the slot and gives -1 for strangers.

    Each level has a bit for every place that exactly one of the digests left hashes to; a digest's slot is the number of
    set bits before its own.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(a)), 0
        while len(left):
            place = self._place(a[left], b[left], len(self.levels), 2 * len(left) + 1)
            bit = np.bincount(place, minlength=2 * len(left) + 1) == 1
            self.levels.append((bit, placed - 1 + np.cumsum(bit)))
            placed += int(bit.sum())
            left = left[~bit[place]]
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.of = self._lookup(a, b)
        self.a[self.of], self.b[self.of] = a, b
        if not (len(np.unique(self.of)) == len(a) == placed):
            raise ValueError("slots are not distinct")

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        code = mix(a.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) ^ b.view(np.uint64)
        return (mix(code) % np.uint64(size)).astype(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = np.full(len(a), -1)
        for level, (bit, rank) in enumerate(self.levels):
            open_ = np.flatnonzero(slot < 0)
            place = self._place(a[open_], b[open_], level, len(bit))
            slot[open_] = np.where(bit[place], rank[place], -1)
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.full(len(a), -1)
        slot = self._lookup(a, b)
        return np.where((self.a[slot] == a) & (self.b[slot] == b), slot, -1)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of one row for each digest."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    return order[new]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


NODE, END, BORDER = 0, 1, 2
_LOCAL = ("kind int, shard bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, depth bigint, t1 bigint, t2 bigint, bytes bigint, "
          "n bigint, ends bigint, conv bigint")


def _batch(schema: str, **columns) -> pa.Table:
    """A table of the schema; columns not given are NULL."""
    size = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    given = {name: x if isinstance(x, pa.Array) else pa.array(x) for name, x in columns.items()}
    return pa.table({name: given[name].cast(kinds[kind]) if name in given else pa.nulls(size, kinds[kind]) for name, kind in fields})


def local_nodes(table: pa.Table, segment: int = SEGMENT) -> pa.Table:
    """Nodes, conversation ends and piece borders of one shard.

    ``table`` has shard, conv_id, depth, u1, u2 (hash of depth and turn), o1, o2 (digest before the piece), t1, t2, bytes, last.
    """
    table = table.sort_by([("conv_id", "ascending"), ("depth", "ascending")])
    conv, depth, last = _column(table, "conv_id"), _column(table, "depth"), _column(table, "last")
    shard = int(table.column("shard")[0].as_py())
    piece = (depth - 1) // segment
    first = np.ones(len(conv), bool)
    first[1:] = (np.diff(conv) != 0) | (np.diff(piece) != 0)
    run = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    digest, parent = [], []
    for u, o in (("u1", "o1"), ("u2", "o2")):
        total = np.bitwise_xor.accumulate(_column(table, u))
        offset = _column(table, o)
        value = total ^ np.where(start[run] > 0, total[start[run] - 1], 0) ^ offset
        digest.append(value)
        parent.append(np.where(first, offset, np.roll(value, 1)))
    one = _distinct(*digest)
    slots = Slots(digest[0][one], digest[1][one])
    at = slots.find(*digest)
    size = len(one)
    n = np.bincount(at, minlength=size)
    ends = np.bincount(at[last], minlength=size)
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, at, conv)
    flat = {}
    for name, values in (("d1", digest[0]), ("d2", digest[1]), ("p1", parent[0]), ("p2", parent[1]), ("depth", depth),
                         *[(c, _column(table, c)) for c in ("t1", "t2", "bytes")]):
        flat[name] = np.empty(size, np.int64)
        flat[name][at] = values
    # Every member must agree on where it comes from and which turn it adds.
    for name, values in (("p1", parent[0]), ("p2", parent[1]), ("depth", depth), ("t1", _column(table, "t1")), ("t2", _column(table, "t2"))):
        if (flat[name][at] != values).any():
            raise ValueError("two prefixes share one digest")
    # What the pieces hang from: the root, or the last node of the piece before.
    hung = np.flatnonzero(first)
    hung = hung[_distinct(parent[0][hung], parent[1][hung])]
    border = np.flatnonzero((depth % segment == 0) & ~last)
    return pa.concat_tables([
        _batch(_LOCAL, kind=np.full(size, NODE), shard=np.full(size, shard), n=n, ends=ends, conv=least, **flat),
        _batch(_LOCAL, kind=np.full(len(hung), NODE), shard=np.full(len(hung), shard), d1=parent[0][hung], d2=parent[1][hung],
               depth=depth[hung] - 1, n=np.zeros(len(hung), np.int64), ends=np.zeros(len(hung), np.int64)),
        _batch(_LOCAL, kind=np.full(int(last.sum()), END), d1=digest[0][last], d2=digest[1][last], conv=conv[last]),
        _batch(_LOCAL, kind=np.full(len(border), BORDER), shard=np.full(len(border), shard), d1=digest[0][border], d2=digest[1][border],
               depth=depth[border], conv=conv[border])])


_PART = ("d1 bigint, d2 bigint, saved bigint, leaves bigint, children bigint, parent_conv bigint, conv bigint, depth bigint, n bigint, "
         "ends_sha256 string")


def subtree_sums(table: pa.Table, segment: int = SEGMENT) -> pa.Table:
    """What one shard adds to its nodes: subtree sums, children, and the facts of the nodes it owns.

    ``table`` has d1, d2, p1, p2, depth, bytes and conv (NULL for nodes that pieces only hang from), all_n, all_ends, all_conv
    of the whole table, and rows with seed_saved and seed_leaves that later pieces add to a border.
    """
    seed = table.column("seed_saved").is_valid().to_numpy()
    nodes = table.filter(pa.array(~seed))
    seeds = table.filter(pa.array(seed))
    a, b, depth = (_column(nodes, c) for c in ("d1", "d2", "depth"))
    # A digest stands twice if one piece ends in the node from which another of this shard hangs.
    hangs = nodes.column("conv").is_null().to_numpy()
    order = np.argsort(hangs, kind="stable")
    kept = order[_distinct(a[order], b[order])]
    hangs, a, b, depth = hangs[kept], a[kept], b[kept], depth[kept]
    slots = Slots(a, b)
    size = len(kept)
    place = slots.of

    def flat(values: np.ndarray) -> np.ndarray:
        out = np.empty(size, np.int64)
        out[place] = values
        return out

    def facts(name: str) -> np.ndarray:
        column = nodes.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        return flat(column[kept])

    all_n, all_ends, all_conv, conv, size_of = (facts(c) for c in ("all_n", "all_ends", "all_conv", "conv", "bytes"))
    level, hang = flat(depth), flat(hangs).astype(bool)
    parent = slots.find(facts("p1"), facts("p2"))
    parent[hang | (level == 0)] = -1
    own = ~hang & (conv == all_conv)
    saved = np.where(own, (all_n - 1) * size_of, 0)
    leaves = (own & (all_n == all_ends)).astype(np.int64)
    if seeds.num_rows:
        at = slots.find(_column(seeds, "d1"), _column(seeds, "d2"))
        np.add.at(saved, at, _column(seeds, "seed_saved"))
        np.add.at(leaves, at, _column(seeds, "seed_leaves"))
    children = np.zeros(size, np.int64)
    np.add.at(children, parent[own & (parent >= 0)], 1)
    # Sums end at the top of a piece: nodes above it get them from seeds at the border.
    up = np.where((level > 1) & ((level - 1) % segment == 0), -1, parent)
    by_depth = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.diff(level[by_depth], prepend=-1))
    for lo, hi in zip(edges, np.append(edges[1:], size)):
        here = by_depth[lo:hi]
        here = here[up[here] >= 0]
        np.add.at(saved, up[here], saved[here])
        np.add.at(leaves, up[here], leaves[here])
    return _batch(_PART, d1=slots.a, d2=slots.b, saved=saved, leaves=leaves, children=children,
                  parent_conv=pa.array(all_conv[parent], mask=~own | (parent < 0)), conv=pa.array(all_conv, mask=~own),
                  depth=pa.array(level, mask=~own), n=pa.array(all_n, mask=~own))


# --- conversations that end in a node ----------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of a sorted partition, comma-joined for each node and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, conv = (batch.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
        text = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(first, np.append(first[1:], len(a)))]
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(conv[first]), pa.array(text)],
                                         names=["d1", "d2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all pieces of a node, in order, holding one piece at a time."""
    node, code, out = None, None, []
    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (a, b) != node:
                if node is not None:
                    out.append((*node, code.hexdigest()))
                node, code = (a, b), hashlib.sha256()
            else:
                code.update(b",")
            code.update(ids.as_buffer())
        if out:
            yield _ends_batch(out)
            out = []
    if node is not None:
        yield _ends_batch([(*node, code.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text)], names=["d1", "d2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end in each node.

    Ids are sorted and joined in ranges of (node, id); only the joined pieces of a node meet, and are hashed one after another.
    """
    keys = ["d1", "d2", "conv"]
    pieces = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _pieces, "d1 bigint, d2 bigint, first bigint, ids string")
    return (pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").select("d1", "d2", "ids")
            .mapInArrow(_digests, "d1 bigint, d2 bigint, ends_sha256 string"))


# --- the whole trie ----------------------------------------------------------------------------------

def _before_pieces(rows: DataFrame) -> DataFrame:
    """Rows with o1 and o2, the digest of all turns before their piece."""
    rest = rows.filter("piece > 0")
    sums = rows.join(rest.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "piece").agg(
        F.bit_xor("u1").alias("x1"), F.bit_xor("u2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "piece", F.bit_xor("x1").over(earlier).alias("o1"), F.bit_xor("x2").over(earlier).alias("o2"))
    zero = F.lit(0).cast("bigint")
    return (rows.filter("piece = 0").withColumns({"o1": zero, "o2": zero})
            .unionByName(rest.join(offsets.filter("piece > 0"), ["conv_id", "piece"])))


def trie(turns: DataFrame, lengths: DataFrame, family: int = 5, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row for each node of the trie of all conversations.

    ``turns`` has conv_id, depth (from 1, without gaps), t1, t2 (hash of the turn), bytes and last; ``lengths`` has conv_id and length,
    turnless conversations too.  Conversations of one family of ids share a shard.  Returned: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Without conversations there is no root.
    Two different prefixes of one digest raise, so a finished result holds no such pair.
    """
    piece = F.floor((F.col("depth") - 1) / segment)
    rows = materialise(turns.withColumns({
        "piece": piece, "u1": F.xxhash64("t1", "depth", "t2"), "u2": F.xxhash64(F.lit(13), "t2", "t1", "depth")}))
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.col("conv_id") - F.col("conv_id") % family, "piece"), F.lit(shards))
    if rows.filter("piece > 0").isEmpty():
        zero = F.lit(0).cast("bigint")
        placed = rows.withColumns({"o1": zero, "o2": zero})
    else:
        placed = _before_pieces(rows)
    placed = placed.withColumn("shard", shard).select("shard", "conv_id", "depth", "u1", "u2", "o1", "o2", "t1", "t2", "bytes", "last")
    local = materialise(placed.groupBy("shard").applyInArrow(lambda t: local_nodes(t, segment), _LOCAL))
    # The root: all conversations are members, those without turns end in it.
    null = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    root = lengths.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") == 0).alias("ends"), F.min("conv_id").alias("conv")).filter(
        "n > 0").select(F.lit(NODE).alias("kind"), F.lit(-1).cast("bigint").alias("shard"), zero.alias("d1"), zero.alias("d2"), null.alias("p1"),
                        null.alias("p2"), zero.alias("depth"), null.alias("t1"), null.alias("t2"), zero.alias("bytes"), "n", "ends", "conv")
    nodes = local.filter(F.col("kind") == NODE).unionByName(root)

    facts = ["p1", "p2", "depth", "t1", "t2", "bytes"]
    whole = materialise(nodes.groupBy("d1", "d2").agg(
        F.sum("n").alias("all_n"), F.sum("ends").alias("all_ends"), F.min("conv").alias("all_conv"),
        *[F.min(c).alias(c) for c in facts], *[F.max(c).alias(f"{c}_") for c in facts]))
    if not whole.filter(F.exists(F.array(*[F.col(c) != F.col(f"{c}_") for c in facts]), lambda x: x)).isEmpty():
        raise ValueError("two prefixes share one digest")

    given = nodes.join(whole.select("d1", "d2", "all_n", "all_ends", "all_conv"), ["d1", "d2"]).select(
        "shard", "d1", "d2", "p1", "p2", "depth", "bytes", "conv", "all_n", "all_ends", "all_conv", null.alias("seed_saved"), null.alias("seed_leaves"))
    seeds = _seeds(local, whole, segment)
    if seeds is not None:
        given = given.unionByName(seeds, allowMissingColumns=True)
    parts = given.groupBy("shard").applyInArrow(lambda t: subtree_sums(t, segment), _PART)
    turnless = lengths.filter("length = 0").select(zero.alias("d1"), zero.alias("d2"), F.col("conv_id").alias("conv"))
    ends = end_digests(local.filter(F.col("kind") == END).select("d1", "d2", "conv").unionByName(turnless))
    parts = parts.unionByName(ends, allowMissingColumns=True)
    total = parts.groupBy("d1", "d2").agg(
        *[F.sum(c).alias(c) for c in ("saved", "leaves", "children")],
        *[F.max(c).alias(c) for c in ("parent_conv", "conv", "depth", "n", "ends_sha256")])
    return total.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def _seeds(local: DataFrame, whole: DataFrame, segment: int) -> DataFrame | None:
    """What nodes of later pieces add to the borders before them; None if no conversation was cut."""
    borders = local.filter(F.col("kind") == BORDER).select(
        "shard", "d1", "d2", F.col("conv"), (F.floor(F.col("depth") / segment) - 1).alias("at"))
    if borders.isEmpty():
        return None
    owned = whole.filter(F.col("depth") > segment).groupBy(
        F.col("all_conv").alias("conv"), (F.floor((F.col("depth") - 1) / segment) - 1).alias("at")).agg(
        F.sum((F.col("all_n") - 1) * F.col("bytes")).alias("seed_saved"), F.count_if(F.col("all_n") == F.col("all_ends")).alias("seed_leaves"))
    later = Window.partitionBy("conv").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = borders.unionByName(owned, allowMissingColumns=True)
    return both.select("shard", "d1", "d2", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("seed_saved", "seed_leaves")]).filter(
        F.col("shard").isNotNull() & ((F.col("seed_saved") > 0) | (F.col("seed_leaves") > 0)))
