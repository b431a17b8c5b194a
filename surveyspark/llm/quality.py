"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed counts of its words' *shapes* (case, length, digits, what punctuation they carry), of
neighbouring shapes, of words that repeat the one before, and of plain words with less weight.  A truncated singular
value decomposition of a bounded sample of labelled texts gives the latent space.  The sample's vectors are
broadcast with their labels; every document's cosine with all of them is one blocked matrix product, and the
nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm import text as tx

# Labelled texts in the sample at most: those with the smallest hashes of their ids.  Label 0 is rare, so
# each label has its own half.
SAMPLE = 4_000
FEATURES = 1_024
LATENT = 48
NEIGHBOURS = 25
# Similarities are raised to this power when neighbours vote.
SHARPNESS = 8.0
THRESHOLD = 0.3

_UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT | tx.SPACE)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of weighted, hashed feature counts for each document."""
    docs = len(offsets) - 1
    out = np.zeros(docs * FEATURES, np.float64)
    words = tx.Words(data, offsets, tx.NOT_SPACE)
    if len(words.start):
        a, b, doc = words.start, words.end, words.doc()
        running = {}
        for name, kind in (("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK)):
            total = np.concatenate([[0], np.cumsum(kind[data])])
            running[name] = total[b] - total[a]
        size = b - a
        last, before = data[b - 1], data[np.maximum(b - 2, a)]
        mark = np.where(_MARK[last], last.astype(np.int64), 0)
        double = (_MARK[before] & _MARK[last] & (size > 1)).astype(np.int64)
        # Shape: shouting, capital, marks inside, digits, the final mark, whether it is doubled.
        case = np.where(running["upper"] == 0, 0, np.where(running["upper"] > 1, 2, 1))
        shape = (case + 3 * (running["digit"] > 0) + 6 * np.minimum(running["mark"], 3) + 24 * double + 48 * (size == 1)) * 256 + mark
        h = words.hashes()
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shape_hash = tx.mix(shape.astype(np.uint64) + np.uint64(11))
        pair = tx.mix(shape_hash[:-1] * np.uint64(3) + shape_hash[1:]) if len(h) > 1 else shape_hash[:0]
        inner = doc[1:] == doc[:-1]
        length = np.maximum(words.count, 1)[doc]
        for code, d, weight in (
                (shape_hash, doc, 1.0 / length), (pair[inner], doc[1:][inner], 0.7 / length[1:][inner]),
                (tx.mix(same.astype(np.uint64) + np.uint64(77)), doc, 2.0 / length), (h, doc, 0.15 / length)):
            cell = d * FEATURES + (code % np.uint64(FEATURES)).astype(np.int64)
            out += np.bincount(cell, np.broadcast_to(weight, len(cell)), minlength=len(out))
    out = np.sqrt(out.reshape(docs, FEATURES))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def feature_rows(texts: DataFrame) -> DataFrame:
    """quality and packed features of each row of ``texts`` (quality, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.chunks(batches, "_bytes"):
            x = features(data, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    return texts.select("quality", tx.utf8().alias("_bytes")).mapInArrow(run, "quality int, x binary")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """quality and text of at most ``size`` labelled rows; rows with conflicting or NULL labels are left out."""
    fine = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
            .filter(F.col("quality") == F.col("high")).select("doc_id", "quality"))
    order = [F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id")]
    picked = None
    for value in (0, 1):
        half = fine.filter(F.col("quality") == value).orderBy(*order).limit(size // 2)
        picked = half if picked is None else picked.unionByName(half)
    # At most ``size`` pairs of numbers, and one text for each: rows that repeat a doc_id count once.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("quality", "text")


class Space:
    """Latent vectors of the sample, unit length, with labels weighted to the labels' true shares."""

    def __init__(self, x: np.ndarray, label: np.ndarray, share: float):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES, np.float32)
        centred = (x - self.mean).astype(np.float64)
        if len(x):
            values, vectors = np.linalg.eigh(centred.T @ centred)
            self.basis = vectors[:, ::-1][:, :LATENT].astype(np.float32)
        else:
            self.basis = np.zeros((FEATURES, LATENT), np.float32)
        self.label = label.astype(np.float32)
        # The sample has as many of each label as it can; votes count as the labels are in all labelled rows.
        ones = max(label.mean(), 1e-9) if len(label) else 0.5
        self.weight = np.where(label == 1, share / ones, (1 - share) / max(1 - ones, 1e-9)).astype(np.float32)
        self.share = share
        self.vectors = self.place(x)

    def place(self, x: np.ndarray) -> np.ndarray:
        y = (x.astype(np.float32) - self.mean) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)


def vote(parts: dict, y: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity."""
    vectors, label, weight = parts["vectors"], parts["label"], parts["weight"]
    k = min(NEIGHBOURS, len(vectors))
    out = np.full(len(y), parts["share"])
    if not k:
        return out
    for lo in range(0, len(y), 256):
        cosine = y[lo:lo + 256] @ vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        strength = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * weight[near]
        total = strength.sum(axis=1)
        with np.errstate(invalid="ignore"):
            value = (strength * label[near]).sum(axis=1) / total
        out[lo:lo + 256] = np.where(total > 0, value, parts["share"])
    return np.clip(out, 0, 1)


def scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SAMPLE) -> DataFrame:
    """``keep`` columns and score (0 to 1, higher: label 1 likelier) of each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality.  NULL and empty texts are scored like a text without features.  Without labelled
    rows all scores are 0.5.  Rows that repeat a doc_id are rows of their own.  Other columns are ignored.
    An empty table gives no rows.
    """
    rows = feature_rows(sample(docs, labels, size)).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(len(rows), FEATURES)
    counts = dict(labels.filter(F.col("quality").isin(0, 1) & ~held_out()).groupBy("quality").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    space = Space(x, np.array([r["quality"] for r in rows], np.int64), share)
    shared = docs.sparkSession.sparkContext.broadcast(vars(space))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        space = Space.__new__(Space)
        space.__dict__.update(parts)
        for batch, data, offsets in tx.chunks(batches, "_bytes"):
            value = vote(parts, space.place(features(data, offsets)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value.astype(np.float64))], names=[*keep, "score"])

    return docs.select(*keep, tx.utf8().alias("_bytes")).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``.

    NULL and empty texts score like a text without features; without labelled rows all rows score 0.5.  Other columns, whatever their
    names, and repeated rows stay as they are.  An empty table gives no rows.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    kept = scores(carried, labels, ("row",)).filter(F.col("score") >= threshold)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
