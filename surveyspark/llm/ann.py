"""Approximate nearest neighbours by a hash-prefix forest, nearest by Euclidean distance.

Every tree gives a vector a string of bits, each the side of a plane between two vectors of a bounded
sample.  A tree is the sorted array of these strings, kept as blocks that share a first part; a block of
many rows is dealt to several tasks.  A query descends to the longest prefix in every tree and ascends in all
trees at once, bit by bit, until the rows under its prefixes are enough.  Those rows are compared exactly,
in double precision, where their block is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.runtime import materialise

TREES = 20
BITS = 48
# Bits of the counted prefixes; longer ones are found inside a block.
DEPTH = 12
# Planes come from this many vectors at most, those with the smallest hashes of their ids.
SAMPLE = 2_000
# A query ascends until its prefixes hold this many rows for each row of the table, over all trees.
SHARE = 1.2
# ... and for so many rows for each neighbour wanted and tree.
SPARE = 4
BLOCK_ROWS = 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double), of the commonest dimension, without NULL, zero and non-finite ones."""
    fine = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    common = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.filter(F.size("vector") == (common["n"] if common else 0))


def planes(vectors: DataFrame, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and offsets of all trees' planes, each half-way between two sampled vectors."""
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r["vector"] for r in sample], np.float64)
    rng = np.random.default_rng(seed)
    a, b = x[rng.integers(0, len(x), trees * BITS)], x[rng.integers(0, len(x), trees * BITS)]
    normal = a - b
    same = ~normal.any(axis=1)
    normal[same] = rng.normal(size=(int(same.sum()), x.shape[1]))
    return normal, ((a + b) / 2 * normal).sum(axis=1)


def _labels(normal: np.ndarray, offset: np.ndarray, trees: int):
    weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def label(vectors: pd.Series) -> pd.Series:
        side = np.stack(vectors.to_numpy()) @ normal.T > offset
        return pd.Series(list((side.reshape(len(side), trees, BITS) * weight).sum(axis=2)))

    return label


def _prefix(label: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", label, F.lit(BITS) - depth)


def nearest(query_id: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of each query's k nearest ids but itself; ties go to smaller ids.

    An id with several rows counts once, at its nearest row.
    """
    norm = (rows * rows).sum(axis=1)
    repeats = len(np.unique(ids)) < len(ids)
    for lo in range(0, len(queries), 256):
        part = queries[lo:lo + 256]
        rough = norm[None, :] - 2 * part @ rows.T
        for i, q in enumerate(part):
            other = np.flatnonzero(ids != query_id[lo + i])
            if len(other) > k:
                value = rough[i, other]
                # Rounding of the quick form must not lose a row: keep all that could be among the nearest.
                slack = 1e-9 * (1 + abs(float(q @ q)) + float(norm.max()))
                most = k
                near = value <= np.partition(value, most - 1)[most - 1] + slack
                while repeats and len(np.unique(ids[other[near]])) < k and most < len(other):
                    most = min(2 * most, len(other))
                    near = value <= np.partition(value, most - 1)[most - 1] + slack
                other = other[near]
            distance = np.sqrt(((rows[other] - q) ** 2).sum(axis=1))
            order = np.lexsort((ids[other], distance))
            if repeats:
                order = order[np.sort(np.unique(ids[other][order], return_index=True)[1])]
            order = order[:k]
            yield query_id[lo + i], ids[other][order], distance[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, share: float = SHARE, seed: int = 1
           ) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query, nearest first.

    ``vectors`` has vec_id and embedding and is indexed whole; ``queries`` are rows of it.  Vectors that are NULL, zero,
    of another dimension than most, or hold NULL or non-finite parts take no part.  Ties go to the smaller vec_id.
    Repeated vec_ids count once, with their nearest vector.  Prefixes hold enough rows for k neighbours at any rate.  Other columns
    are ignored.
    """
    schema = "query_id bigint, vec_id bigint, score double"
    good = materialise(usable(vectors).dropDuplicates(["vec_id", "vector"]))
    n = good.count()
    if not n:
        return (good.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double"))
    label = _labels(*planes(good, trees, seed), trees)
    block_bits = int(np.clip(np.floor(np.log2(max(1, n / BLOCK_ROWS))), 0, DEPTH))
    index = (good.select("vec_id", "vector", label("vector").alias("labels"))
             .select("vec_id", "vector", F.posexplode("labels").alias("tree", "label")))
    counts = materialise(good.select(F.posexplode(label("vector")).alias("tree", "label"))
                         .groupBy("tree", _prefix(F.col("label"), DEPTH).alias("prefix")).agg(F.count(F.lit(1)).alias("rows")))
    depths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    by_depth = (counts.select("tree", "prefix", "rows", depths)
                .groupBy("tree", "depth", F.call_function("shiftright", "prefix", F.lit(DEPTH) - F.col("depth")).alias("prefix"))
                .agg(F.sum("rows").alias("rows")))

    wanted = queries.select("vec_id").distinct()
    asked = (good.join(wanted, "vec_id", "left_semi").withColumn("place", F.monotonically_increasing_id()))
    asked = materialise(asked.select("vec_id", "place", "vector", label("vector").alias("labels")))
    steps = (asked.select("place", F.posexplode("labels").alias("tree", "label"))
             .select("place", "tree", "label", depths).withColumn("prefix", _prefix(F.col("label"), F.col("depth"))))
    # k + 1 rows in each tree on average would make sure of k neighbours; some times as many find near ones.
    enough = min(max(share * n, float(SPARE * trees * (k + 1))), float(trees * n))
    depth = (steps.join(by_depth, ["tree", "depth", "prefix"]).groupBy("place", "depth").agg(F.sum("rows").alias("rows"))
             .filter(F.col("rows") >= enough).groupBy("place").agg(F.max("depth").alias("depth")))

    salts = by_depth.filter(F.col("depth") == block_bits).select(
        "tree", F.col("prefix").alias("block"), F.ceil(F.col("rows") / (2 * BLOCK_ROWS)).cast("int").alias("salts"))
    salts = materialise(salts)
    data = (index.withColumn("block", _prefix(F.col("label"), block_bits)).join(salts, ["tree", "block"])
            .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
            .select("tree", "block", "salt", "label", "vec_id", "vector"))
    shift = F.greatest(F.lit(block_bits) - F.col("depth"), F.lit(0))
    low = F.call_function("shiftleft", _prefix(F.col("label"), F.least("depth", F.lit(block_bits))), shift)
    visits = (asked.select("vec_id", "place", "vector", F.posexplode("labels").alias("tree", "label")).join(depth, "place")
              .select("vec_id", "vector", "tree", "label", "depth", F.explode(F.sequence(
                  low, low + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1)).alias("block"))
              .join(salts, ["tree", "block"])
              .select("tree", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                      "label", "depth", "vec_id", "vector"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("label")
            labels = left.column("label").to_numpy()
            ids = left.column("vec_id").to_numpy()
            rows = np.array(left.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)
            asked_id = right.column("vec_id").to_numpy()
            vector = np.array(right.column("vector").combine_chunks().flatten()).reshape(len(asked_id), -1)
            deep = right.column("depth").to_numpy().astype(np.int64)
            start = (right.column("label").to_numpy() >> (BITS - deep)) << (BITS - deep)
            ranges = np.stack([np.searchsorted(labels, start), np.searchsorted(labels, start + (np.int64(1) << (BITS - deep)))])
            # Queries that look at the same part of the sorted array go together.
            for a, b in np.unique(ranges, axis=1).T:
                use = np.flatnonzero((ranges[0] == a) & (ranges[1] == b))
                if b > a:
                    for q, near, score in nearest(asked_id[use], vector[use], ids[a:b], rows[a:b], k):
                        out[0] += [q] * len(near)
                        out[1] += near.tolist()
                        out[2] += score.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    keys = ("tree", "block", "salt")
    found = data.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(compare, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
