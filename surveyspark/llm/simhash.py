"""SimHash near-duplicates: fingerprints of 64 bits that differ in few of them, by deletion variants.

Fingerprints are cut into two segments.  If two of them differ in at most three bits, one segment differs in at most one.
So each distinct fingerprint is filed under each of its segments as it is, and under each with one bit taken out; an equality
join on these keys meets every link, and whole fingerprints are compared.  A key belongs to one sort of difference (none, or
in this bit), so a link is looked for under one key only.

A key that very many fingerprints share is not left to one task: what they still differ in is cut the same way,
again and again, until eight free bits and three wildcards, 2,048 fingerprints at most, are left.  Within a key links are
followed only as far as they join what was apart, so it gives fewer edges than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.components import connected_components
from surveyspark.llm.text import utf8
from surveyspark.runtime import materialise

SHINGLE, SEED, BITS = 3, 42, 64
DISTANCE = 3
# Fingerprints under one key that a task compares; a proven bound only if at least 2^(8 + DISTANCE).
GROUP = 4_096
# Words whose hashes are held at once.
BLOCK_WORDS = 1 << 16


# --- fingerprints ------------------------------------------------------------------------------------

def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of all word shingles, repeats included; no words give zero."""
    # bytes.lower and bytes.split know ASCII alone: A-Z, and space and 0x09-0x0D.
    words = text.lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, BLOCK_WORDS):
        some = words[lo:lo + BLOCK_WORDS + size - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]) - 1
        starts = np.append(0, ends[:-1] + 1)
        last = ends[min(size, len(some)) - 1:]
        codes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:len(last)].tolist(), last.tolist())], ">u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(bytes(x.as_buffer())) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], names=["doc_id", "print"])

    return docs.select("doc_id", utf8().alias("_bytes")).mapInArrow(run, f"doc_id {kind}, print bigint")


# --- keys --------------------------------------------------------------------------------------------

def filed(prints: DataFrame, value: Column, width: int, name: str) -> DataFrame:
    """A row for each key (column ``name``) of a pattern of ``width`` bits, cut in two: each half as it is, and with each bit taken out.

    A key holds the number of the variant above the bits; the number tells the half and the bit (none is the half's width).
    """
    half = width // 2
    number = F.col("_number")
    bits = F.call_function("shiftrightunsigned", "_value", F.when(number > half, half).otherwise(0)).bitwiseAND(F.lit((1 << half) - 1))
    place = number % (half + 1)
    taken = F.when(place < half, F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint"))
    key = F.call_function("shiftleft", number.cast("bigint"), F.lit(half)) + bits.bitwiseAND(F.bitwise_not(taken))
    return (prints.withColumn("_value", value).withColumn("_number", F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))))
            .withColumn(name, key).drop("_value", "_number"))


def other_half(value: Column, key: Column, width: int) -> Column:
    """The half of the pattern that the key leaves open."""
    half = width // 2
    in_low = F.call_function("shiftright", key, F.lit(half)) <= half
    low = value.bitwiseAND(F.lit((1 << half) - 1))
    return F.when(in_low, F.call_function("shiftrightunsigned", value, F.lit(half)).bitwiseAND(F.lit((1 << half) - 1))).otherwise(low)


# --- comparing what shares a key ---------------------------------------------------------------------

def _links(a: np.ndarray, b: np.ndarray, number: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are links to be found under this variant of the whole fingerprint.

    Under a half as it is the halves are equal; under a missing bit they differ in it.  The low half goes first, so a pair whose
    low halves differ in one bit at most isn't looked for under the high half.
    """
    x = a ^ b
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    place = number % 33
    mine = np.where(number > 32, high, low)
    want = np.where(place < 32, np.uint64(1) << np.minimum(place, 31).astype(np.uint64), np.uint64(0))
    first = (number <= 32) | (np.bitwise_count(low) > 1)
    return (np.bitwise_count(x) <= distance) & (mine == want) & first


def spanning_links(key: np.ndarray, prints: np.ndarray, number: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all linked fingerprints of each key; rows come sorted by ``key``."""
    n = len(key)
    stop = np.searchsorted(key, key, "right")
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    here = np.arange(n)
    step = 1
    while True:
        here = here[here + step < stop[here]]
        if not len(here):
            return prints[left], prints[right]
        there = here + step
        use = _links(prints[here], prints[there], number[here], distance) & (root[here] != root[there])
        for i, j in zip(here[use].tolist(), there[use].tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
        if use.any():
            while (root[root] != root).any():
                root = root[root]
        step += 1


def _compare(batches: Iterator[pa.RecordBatch], keys: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Edges from a partition sorted by its key columns; a key's rows may run over several batches."""
    held: list[np.ndarray] | None = None

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        run = np.cumsum(new)
        size = np.bincount(run)
        many = size[run] > 1
        a, b = spanning_links(run[many], columns[keys][many].view(np.uint64), (columns[0][many] >> 32).astype(np.int64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys + 1)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        same = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield edges([c[:cut] for c in columns])
    if held is not None:
        yield edges(held)


def _edges(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    sorted_ = rows.select(*keys, "print").repartition(*keys).sortWithinPartitions(*keys, "print")
    return sorted_.mapInArrow(lambda batches: _compare(batches, len(keys), distance), "a bigint, b bigint")


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all distinct ``print`` values with at most ``distance`` differing bits (three at most).

    Keys of over ``group`` fingerprints are filed again by what they leave open.  How many a key has follows from counts
    of the halves: it joins two of their values at most.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments find at most three differing bits")
    low, high = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", "print", F.lit(32))
    halves = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("bits")),
                                             F.struct(F.lit(1).alias("half"), high.alias("bits")))).alias("s")).select("s.*")
    large = materialise(halves.groupBy("half", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group // 2))
    rows = filed(prints, F.col("print"), 64, "key")
    if large.isEmpty():
        return _edges(rows, ["key"], distance)
    # All keys of a large half, in the form that filing gives them.
    pattern = F.when(F.col("half") == 0, F.col("bits")).otherwise(F.call_function("shiftleft", "bits", F.lit(32)))
    crowded = materialise(filed(large, pattern, 64, "key").filter(
        (F.call_function("shiftright", "key", F.lit(32)) > 32).cast("int") == F.col("half")).select("key").distinct())
    out = _edges(rows.join(crowded, "key", "left_anti"), ["key"], distance)
    rest = rows.join(crowded, "key", "left_semi").withColumn("open", other_half(F.col("print"), F.col("key"), 64))
    keys, width = ["key"], 32
    for name in ("key2", "key3"):
        rest = filed(rest, F.col("open"), width, name).withColumn("open", other_half(F.col("open"), F.col(name), width))
        keys, width = [*keys, name], width // 2
        if width > 8:
            sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select(*keys)
            crowded = materialise(sizes)
            out = out.unionByName(_edges(rest.join(crowded, keys, "left_anti"), keys, distance))
            rest = rest.join(crowded, keys, "left_semi")
    return out.unionByName(_edges(rest, keys, distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: a row for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach.  NULL and empty texts have fingerprint zero and link like any other.
    Equal fingerprints are one node, so copies cost nothing more.  Rows without doc_id take part, but name a component
    only if it has no other (then NULL); repeated doc_ids are rows of their own.  Other columns are ignored; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs))
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(nodes.select("print"), distance, group))
    named = materialise(nodes.join(found, nodes["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
