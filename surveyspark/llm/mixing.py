"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Sources are ranked by name and take the given weights in turn.  A source's target is its share of all
words by weight, but at most ``most`` times its own words; what that leaves over goes to the others by
weight.  Each source is put in hash order and cut into ranges of the hash; sums of ranges give each
range its offset, so a prefix sum never needs a whole source in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm import text as tx
from surveyspark.runtime import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
# Rows of a range on average; only the number of ranges depends on a source's rows.
RANGE_ROWS = 20_000
# Hash keys have this many bits.
KEY_BITS = 40


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and size, the number of runs of non-space characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch, data, offsets in tx.chunks(batches, "_bytes", 1 << 20):
                mask = tx.NOT_SPACE[data]
                start = mask.copy()
                start[1:] &= ~mask[:-1]
                inner = offsets[:-1][offsets[:-1] < len(mask)]
                start[inner] = mask[inner]
                count = np.concatenate([[0], np.cumsum(start)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(count[offsets[1:]] - count[offsets[:-1]])],
                    names=["doc_id", "source", "text_hash", "size"])
        yield from tx.gathered(each())

    return (docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), tx.utf8().alias("_bytes"))
            .mapInArrow(run, "doc_id bigint, source string, text_hash bigint, size bigint"))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``totals`` (source, rows, source_size, one row a source) with each source's target.

    Capped sources are those with the smallest size for their weight, so sorted that way they come first:
    the others share what the capped ones leave, by weight.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    capped = ranked.select("source", "rows", "source_size", weight.cast("bigint").alias("weight"),
                           (F.col("source_size") * most).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = capped.select(
        "*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"))
    # The first source whose share fits under its cap, and all after it, are open.
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("open")
    shared = shared.select("*", F.first(F.when(fits, F.struct("left", "open")), ignorenulls=True)
                           .over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.col("level.left") * F.col("weight") / F.col("level.open"))
    return shared.select("source", "rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and taken of each row of ``docs``.

    ``docs`` has doc_id, source and text; other columns are ignored.  ``taken`` counts words, repeats
    included: each full epoch takes every document of the source, the last one takes documents in hash order up
    to the target rounded to whole words, so the document at the cut may be taken in part.  A NULL source is
    a source of its own, a NULL text has size 0.  Repeated rows are ordered by id and text and are
    otherwise separate rows.  Reruns agree.  An empty table gives no rows.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 64 - KEY_BITS)
    rows = materialise(sizes(docs).withColumn("key", key))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    plan = materialise(targets(totals, weights, most))
    given = plan.select(F.col("source").alias("_source"), "rows", "source_size", "target")
    ranges = F.least(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1 << 22))
    placed = (rows.join(given, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("range", F.shiftright(F.col("key") * ranges, KEY_BITS)))
    offset = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(F.col("source").alias("_source"), F.col("range").alias("_range")).agg(F.sum("size").alias("words"))
               .select("_source", "_range", F.coalesce(F.sum("words").over(offset), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = placed.drop("_source").withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ordered = ahead.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("offset") - F.col("ahead"), F.lit(0)), F.col("size"))
    return ordered.select("doc_id", "source", "text_hash", "size", "source_size", "target",
                          (epochs * F.col("size") + last).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with mix_size, mix_source_size, mix_target and mix_taken (words, repeats counted).

    NULL sources, NULL and empty texts and repeated rows are treated as in :func:`mix`; rows without words are never taken.  Other
    columns stay, except that one named like an added column gives way to it.  An empty table gives no rows.
    """
    added = [f"mix_{x}" for x in ("size", "source_size", "target", "taken")]
    taken = (mix(docs.select("doc_id", "source", "text"), weights, most, seed).filter("taken > 0")
             .groupBy(*[F.col(c).alias(f"in_{c}") for c in ("doc_id", "source", "text_hash")])
             .agg(*[F.max(x[4:]).alias(x) for x in added]))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    same = [F.col(c).eqNullSafe(F.col(f"in_{c}")) for c in ("doc_id", "source")]
    joined = carried.join(taken, same[0] & same[1] & (F.col("text_hash") == F.col("in_text_hash")))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)
