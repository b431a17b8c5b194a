"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

An item's windows are the sets to find, a document's shingles the place to look.  A window can only
stand where all its shingles stand, so its rarest shingle is a sufficient prefix: the shingles of the
benchmark are counted in the documents, each window takes its rarest one, and documents join on that
alone.  Where it stands in a document fixes where the window must start; a window that would begin before the
document or end after it is out.  What is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import with_words
from surveyspark.runtime import materialise

WINDOW = 10
SHINGLE = 5
# A shingle hash that stands for the document itself, so that documents without matches are kept.
DOCUMENT = 0


def _shingle_hashes(tokens: Column, size: int) -> Column:
    last = F.size(tokens) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[tokens[i + j] for j in range(size)]))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_words, n, items): distinct windows with the items that have them; wordless items have none."""
    tokens = with_words(benchmark, "item_id").filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (tokens.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("window_words"))
            .groupBy("window_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
            .select("window_words", F.size("window_words").alias("n"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) and _row of each row of ``docs`` (doc_id, text).

    ``benchmark`` has item_id and text.  A NULL text has no words; a NULL item_id is found (its words are
    hit) but not listed.  Rows that repeat a doc_id have results of their own.  Other columns are ignored.
    Empty documents give no rows, an empty benchmark no hits.
    """
    windows = materialise(item_windows(benchmark, window))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())
    windows = windows.withColumn("size", F.least("n", F.lit(shingle)))
    parts = None
    for size in sizes:
        part = (windows.filter(F.col("size") == size)
                .select("window_words", "n", "items", F.posexplode(_shingle_hashes(F.col("window_words"), size)).alias("offset", "hash")))
        parts = part if parts is None else parts.unionByName(part)
    names = docs.sparkSession.range(1).select(F.lit(DOCUMENT).cast("bigint").alias("hash"))
    known = (names if parts is None else names.unionByName(parts.select("hash"))).distinct()

    # All positions of benchmark shingles, and position -1 of each document.
    tokens = with_words(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    tokens = tokens.select("doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"),
                           F.concat(F.array(F.lit(DOCUMENT).cast("bigint")), *[_shingle_hashes(F.col("w"), k) for k in sizes])
                           .alias("hashes"))
    place = F.col("at") - 1
    # Where the shingles of each size begin in the joined array.
    position, passed = F.lit(-1), F.lit(0)
    for size in sizes:
        count = F.greatest(F.col("n_words") - size + 1, F.lit(0))
        position = F.when(place >= passed, place - passed).otherwise(position)
        passed = passed + count
    found = materialise(tokens.select("doc_id", "text_hash", "n_words", F.posexplode("hashes").alias("at", "hash"))
                        .join(known, "hash")
                        .select("doc_id", "text_hash", "n_words", position.cast("bigint").alias("position"), "hash"))
    base = found.filter(F.col("hash") == DOCUMENT).select("doc_id", "text_hash", "n_words")
    if parts is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"),
                           F.array().cast("array<string>").alias("items"), "text_hash")

    found = found.filter(F.col("hash") != DOCUMENT)
    frequency = found.groupBy("hash").agg(F.count(F.lit(1)).alias("frequency"))
    # A window one of whose shingles stands nowhere needs no look.
    prefix = (parts.join(frequency, "hash", "left")
              .groupBy("window_words", "n", "items")
              .agg(F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "hash", "offset")).alias("rarest"))
              .filter(F.col("rarest.frequency") > 0)
              .select("window_words", "n", "items", "rarest.hash", "rarest.offset"))
    candidates = (found.join(prefix, "hash")
                  .withColumn("start", F.col("position") - F.col("offset"))
                  .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
                  .groupBy("doc_id", "text_hash")
                  .agg(F.array_sort(F.collect_set(F.struct("start", "n", "window_words", "items"))).alias("candidates")))
    candidates = materialise(candidates)
    suspects = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
                .join(candidates.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}),
                      F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))))
    checked = (with_words(suspects, "doc_id", "text_hash", "candidates")
               .select("doc_id", "text_hash", F.filter("candidates", lambda c: F.slice(
                   F.col("w"), (c["start"] + 1).cast("int"), c["n"]) == c["window_words"]).alias("hits"))
               .filter(F.size("hits") > 0)
               .dropDuplicates(["doc_id", "text_hash"]))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))
    covered = F.aggregate("hits", zero, lambda s, h: F.struct(
        F.greatest(s["end"], h["start"] + h["n"]).alias("end"),
        (s["hit"] + F.greatest(h["start"] + h["n"] - F.greatest(s["end"], h["start"]), F.lit(0))).alias("hit")))
    hits = checked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), covered["hit"].alias("hit"),
                          F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("found"))
    return (base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
            .select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("found", F.array().cast("array<string>")).alias("items"), "text_hash"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` without any hit.

    NULL and wordless texts stay, and so do all rows if the benchmark is empty.  Other columns, whatever their names, and repeated rows
    stay as they are.  An empty table gives no rows.
    """
    none = F.lit(-(1 << 63))
    bad = (contamination(docs.select("doc_id", "text"), benchmark, window, shingle).filter("n_hit > 0")
           .select(F.coalesce("doc_id", none).alias("row_id"), F.col("text_hash").alias("row_hash")).distinct())
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", none).alias("row_id"),
                          F.xxhash64("text").alias("row_hash"))
    kept = carried.join(bad, ["row_id", "row_hash"], "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
