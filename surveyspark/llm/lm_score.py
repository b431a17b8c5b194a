"""Cross-entropy difference of two matched n-gram models over one vocabulary.

The background model is counted over all documents, the target model over those marked as target.  Both
are bigram models interpolated with their unigram models, and both use the same vocabulary: every word of the
corpus.  A token's loss difference is background loss minus target loss,
and a document's score is the mean over its tokens: higher is closer to the target.

Words are counted first.  Words and pairs that hold a fixed share of all tokens, a bounded number, are sent with their counts to
all tasks.  Documents that a task reads together are a block, of about ``PACK`` tokens.  Every other pair of a block travels once, with
its counts there, to the bucket that counts and values it over all blocks; the values travel back to the block, in the order in which the
pairs were sent, and the block adds them to its documents.  So what travels depends on the pairs of blocks, not on the number of
buckets or of documents in each of them.  A pair with an uncommon word goes to the bucket of that word, so that bucket
needs the counts of its own words and of second words of pairs of two uncommon ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import text as tx
from surveyspark.llm.suffix_dedup import squeezed, unsqueezed
from surveyspark.runtime import materialise

# Words that make up one in four times this many tokens and pairs that make up one in this many are sent to all tasks.
COMMON = 1 << 17
# Weight of the bigram model in both models.
BIGRAM = 0.7
# Stands before the first and after the last word of a document.
BOUND = 0
# Tokens, and documents, that a task packs together.
PACK = 1 << 20
# Tokens for each bucket, as long as there are no more buckets than the cluster's setting gives.
BUCKET = 3 << 20


class Pairs:
    """Neighbouring words of concatenated documents, with the bound before the first and after the last word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = tx.Words(tx.lower(data), offsets, tx.ALNUM)
        some = words.count > 0
        begin, end = words.first[:-1][some], words.first[1:][some]
        self.count = words.count
        hashes, docs = words.hashes(), words.doc()
        self.first = np.insert(hashes, begin, np.uint64(BOUND))
        self.second = np.insert(hashes, end, np.uint64(BOUND))
        self.doc = np.insert(docs, begin, np.flatnonzero(some))


def flags_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("is_target")).to_numpy(zero_copy_only=False).astype(np.int8)


def pair_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return tx.mix(tx.mix(first) + second)


def word_counts(rows: DataFrame, common: int) -> DataFrame:
    """(first, second, n, t): counts of words over all documents and over those of the target; ``second`` is NULL.

    Rows with ``second`` are pairs that are frequent in a part of the rows that a task counts together, with their counts there:
    a pair that makes up one in ``common`` tokens of all rows does so in one of the parts.  Pairs that a part has once are left out.
    """
    names = ["first", "second", "n", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def counted(code, flag):
            unique, at, inverse = np.unique(code, return_index=True, return_inverse=True)
            return at, np.bincount(inverse, minlength=len(unique)), np.bincount(inverse, flag, minlength=len(unique)).astype(np.int64)

        def take():
            first, second, flag = (np.concatenate(x) for x in zip(*held))
            held.clear()
            word = first != np.uint64(BOUND)
            at, n, t = counted(first[word], flag[word])
            yield pa.RecordBatch.from_arrays([pa.array(first[word][at].view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(n), pa.array(t)], names=names)
            pair = second != np.uint64(BOUND)
            first, second, flag = first[pair], second[pair], flag[pair]
            at, n, t = counted(pair_code(first, second), flag)
            often = (n * common >= len(first)) & (n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (first[at].view(np.int64), second[at].view(np.int64), n, t)], names=names)

        for batch, data, offsets in tx.chunks(unsqueezed(batches, 1, 300), "_bytes", 1 << 20):
            flag = flags_of(batch)
            x = Pairs(data, offsets)
            held.append((x.first, x.second, flag[x.doc]))
            if sum(len(h[0]) for h in held) >= PACK:
                yield from take()
        if held:
            yield from take()

    return (rows.select("is_target", "_bytes").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
            .groupBy("first", "second").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


class Known:
    """Sorted codes with their two counts."""

    def __init__(self, table: pa.Table):
        code = table.column(0).to_numpy().view(np.uint64)
        order = np.argsort(code)
        self.code, self.n, self.t = code[order], table.column(1).to_numpy()[order], table.column(2).to_numpy()[order]

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code stands, and whether it is there at all."""
        if not len(self.code):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        return at, self.code[at] == wanted


class Packed:
    """The pairs of a block, dealt to buckets, and what the block needs to add their values to its documents.

    Each pair of the block stands once, words by their place in a list.  ``known`` holds the common words, of which numbers are sent;
    other words are sent whole.  Blocks are numbered by partition, so a task that is run again makes the same ones of the same rows.
    """

    PAIRS = {"common": np.uint32, "rare": np.uint64, "runs": np.uint32, "second": np.uint32, "n": np.uint32, "t": np.uint32}
    # Of each document: tokens and the sum over its frequent pairs.  Of each pair, in the order of buckets and in them as sent: the
    # number of documents that hold it, then those documents and how often each does.
    BLOCK = {"tokens": np.uint32, "part": np.float64, "holders": np.uint32, "doc": np.uint32, "times": np.uint32}

    def __init__(self, known: Known, bucket_of_pair: Callable[[np.ndarray, np.ndarray], np.ndarray], buckets: int, partition: int):
        self.known, self.bucket_of_pair, self.buckets = known, bucket_of_pair, buckets
        self.block = partition << 32
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.kept: list[tuple] = []
        self.held = self.docs = 0

    def add(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray, ids: pa.Array, flags: np.ndarray, tokens: np.ndarray,
            part: np.ndarray) -> None:
        self.parts.append((first, second, doc + self.docs))
        self.kept.append((ids, flags, tokens, part))
        self.held += len(first)
        self.docs += len(flags)

    def take(self) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, and one of the block, without pairs but with its documents."""
        if not self.docs:
            return
        first, second, doc = (np.concatenate(x) for x in zip(*self.parts))
        ids, flags, tokens, part = zip(*self.kept)
        ids, flags = pa.concat_arrays(ids), np.concatenate(flags)
        docs, block = self.docs, self.block
        self.parts, self.kept, self.held, self.docs, self.block = [], [], 0, 0, block + 1
        vocabulary, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        # Both words and the document in one number, which sorts them; it has room for a million each, or one long document.
        w, d = np.uint64(len(vocabulary).bit_length()), np.uint64(docs.bit_length())
        place = place.astype(np.uint64)
        entry = np.sort((place[:len(first)] << (w + d)) | (place[len(first):] << d) | doc.astype(np.uint64))
        edge = np.flatnonzero(np.diff(entry, prepend=entry[:1]) != 0) if len(entry) else np.zeros(0, np.int64)
        edge = np.concatenate([np.zeros(min(len(entry), 1), np.int64), edge])
        times = np.diff(np.append(edge, len(entry)))
        entry = entry[edge]
        doc = (entry & ((np.uint64(1) << d) - np.uint64(1))).astype(np.int64)
        pair, begin, holders = np.unique(entry >> d, return_index=True, return_counts=True)
        first, second = (pair >> w).astype(np.int64), (pair & ((np.uint64(1) << w) - np.uint64(1))).astype(np.int64)
        n, t = (np.add.reduceat(x, begin) if len(begin) else x for x in (times, times * flags[doc]))
        bucket = self.bucket_of_pair(vocabulary[first], vocabulary[second])
        number, common = self.known.places(vocabulary)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows, sent = [], [np.zeros(0, np.int64)]
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            at = order[a:b]
            words, place = np.unique(np.concatenate([first[at], second[at]]), return_inverse=True)
            runs = np.bincount(place[:len(at)], minlength=len(words))
            mine = common[words]
            place = np.where(mine, np.cumsum(mine) - 1, mine.sum() + np.cumsum(~mine) - 1)[place[len(at):]]
            # Runs follow the order of the vocabulary among common words, then among the others.
            by_kind = np.argsort(~mine, kind="stable")
            entries = np.argsort(~mine[np.repeat(np.arange(len(words)), runs)], kind="stable")
            at = at[entries]
            columns = (np.diff(number[words][mine], prepend=0), vocabulary[words][~mine], runs[by_kind], place[entries], n[at], t[at])
            rows.append([_squeezed(x.astype(kind)) for x, kind in zip(columns, self.PAIRS.values())])
            sent.append(at)
        sent = np.concatenate(sent)
        holders, begin = holders[sent], begin[sent]
        at = np.arange(holders.sum()) + np.repeat(begin - (np.cumsum(holders) - holders), holders)
        whole = (np.concatenate(tokens), np.concatenate(part), holders, doc[at], times[at])
        own = [_squeezed(x.astype(kind)) for x, kind in zip(whole, self.BLOCK.values())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(bucket[order][cut], block % self.buckets).astype(np.int32)), pa.array(np.full(len(rows) + 1, block))]
            + [pa.array([*(r[i] for r in rows), None], pa.binary()) for i in range(len(self.PAIRS))]
            + [pa.array([None] * len(rows) + [x], pa.binary()) for x in own]
            + [pa.ListArray.from_arrays(pa.array([None] * len(rows) + [0, len(ids)], pa.int32()), ids)],
            names=["bucket", "block", *self.PAIRS, *self.BLOCK, "ids"])

    @classmethod
    def schema(cls, kind: str) -> str:
        return "bucket int, block bigint, " + ", ".join(f"{n} binary" for n in [*cls.PAIRS, *cls.BLOCK]) + f", ids array<{kind}>"

    @classmethod
    def unpack(cls, table: pa.Table, known: Known) -> tuple[np.ndarray, ...]:
        """First and second word and both counts of every pair; the pairs of each row."""
        parts = []
        for row in zip(*(table.column(n) for n in cls.PAIRS)):
            common, rare, runs, second, n, t = (_restored(x.as_py(), kind) for x, kind in zip(row, cls.PAIRS.values()))
            words = np.concatenate([known.code[np.cumsum(common, dtype=np.int64)], rare])
            parts.append((np.repeat(words, runs), words[second], n, t))
        sizes = np.array([len(x[0]) for x in parts], np.int64)
        kinds = (np.uint64, np.uint64, np.uint32, np.uint32)
        return *(tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, k) for k in kinds)), sizes


def valued(block: pa.Table) -> pa.Table:
    """doc_id, n_tokens and score of the documents of a block, of its own row and the values that its buckets sent back."""
    mine = pc.is_valid(block.column("ids"))
    own, sent = block.filter(mine), block.filter(pc.invert(mine)).sort_by("bucket")
    tokens, part, holders, doc, times = (_restored(own.column(n)[0].as_py(), kind) for n, kind in Packed.BLOCK.items())
    value = np.concatenate([np.zeros(0), *(_restored(x.as_py(), np.float64) for x in sent.column("value"))])
    if own.num_rows != 1 or len(value) != len(holders):
        raise RuntimeError("A block has other pairs than were sent: its rows changed between two reads.")
    part = part + np.bincount(doc, np.repeat(value, holders) * times, len(tokens))
    return pa.table({"doc_id": own.column("ids").combine_chunks().flatten(), "n_tokens": tokens.astype(np.int64),
                     "score": np.where(tokens > 0, part / np.maximum(tokens, 1), 0.0)})


def _squeezed(array: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones, compressed: their number, then the rest."""
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return len(array).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _restored(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def scores(docs: DataFrame, target_ids: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, n_tokens and score of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``target_ids`` has the doc_ids of the target's documents.  A NULL or wordless text has no tokens and score 0.
    Rows that repeat a doc_id are rows of their own; all of them count in the models.  Without a target document
    the target model is its smoothing alone.  An empty table gives no rows.  ``common`` changes no score.
    """
    context = docs.sparkSession.sparkContext
    flags = target_ids.select(F.col("doc_id").alias("_target"), F.lit(True).alias("_flag")).filter("_target is not null").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = squeezed(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), tx.utf8().alias("_bytes")))
    # Rows without doc_id match nothing; their keys spread them.  Texts are squeezed for this one shuffle and for the written table.
    rows = materialise(keyed.join(flags.hint("shuffle_hash"), (F.coalesce("doc_id", "key") == F.col("_target")) & F.col("doc_id").isNotNull(), "left")
                       .select("doc_id", F.coalesce("_flag", F.lit(False)).alias("is_target"), "_bytes"))
    counted = materialise(word_counts(rows, common), compression="zstd")
    words = counted.filter("second is null").select(F.col("first").alias("word"), "n", "t")
    size, total_n, total_t = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    # Before a first word is nothing, which has no count: the unigram model alone counts.
    bound = pa.table({"word": np.array([BOUND]), "n": np.array([0]), "t": np.array([0])})
    often = F.col("n") * 4 * common >= total_n
    top_words = context.broadcast(Known(pa.concat_tables([words.filter(often).toArrow().cast(bound.schema), bound])))
    frequent = counted.filter(F.col("second").isNotNull() & (F.col("n") * common >= total_n)).select("first", "second").toArrow()
    code = pair_code(*(frequent.column(i).to_numpy().view(np.uint64) for i in (0, 1)))
    wanted = context.broadcast(Known(pa.table([pa.array(code.view(np.int64))] * 3, names=["pair", "n", "t"])))
    buckets = min(tx.n_buckets(rows), total_n // BUCKET + 1)

    def bucket_of_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        known_first, known_second = (top_words.value.places(x)[1] for x in (first, second))
        return tx.bucket_of(np.where(~known_first, first, np.where(~known_second, second, pair_code(first, second))), buckets)

    def pairs(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
        for batch, data, offsets in tx.chunks(unsqueezed(batches, at, 300), "_bytes", 1 << 20):
            x = Pairs(data, offsets)
            use = x.second != np.uint64(BOUND)
            yield batch, x, x.first[use], x.second[use], x.doc[use]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of frequent pairs (bucket -1), and the bucket and second word of pairs of two uncommon words."""
        spec = ["bucket", "code", "n", "t"]
        n, t = (np.zeros(len(wanted.value.code), np.int64) for _ in range(2))
        for batch, x, first, second, doc in pairs(batches, 1):
            flag = flags_of(batch)
            at, found = wanted.value.places(pair_code(first, second))
            n += np.bincount(at[found], minlength=len(n))
            t += np.bincount(at[found], flag[doc[found]], minlength=len(n)).astype(np.int64)
            rare = ~(top_words.value.places(first)[1] | found)
            first, second = first[rare], second[rare]
            rare = ~top_words.value.places(second)[1]
            first, second = first[rare], second[rare]
            bucket = tx.bucket_of(first, buckets)
            _, at = np.unique(tx.mix(second + bucket.astype(np.uint64)), return_index=True)
            none = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(second[at].view(np.int64)), pa.array(none), pa.array(none)], names=spec)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), -1, np.int32)), pa.array(wanted.value.code.view(np.int64)), pa.array(n), pa.array(t)], names=spec)

    answers = materialise(rows.select("is_target", "_bytes").mapInArrow(asked, "bucket int, code bigint, n bigint, t bigint"), compression="zstd")
    rare_words = words.filter(~often)

    def own_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = tx.bucket_of(batch.column(0).to_numpy().view(np.uint64), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "word", "n", "t"])

    needed = (answers.filter("bucket >= 0").select("bucket", F.col("code").alias("word")).distinct().join(rare_words, "word")
              .select("bucket", "word", "n", "t").unionByName(rare_words.mapInArrow(own_bucket, "bucket int, word bigint, n bigint, t bigint")))

    def values(first, second, n, t, *known: Known) -> np.ndarray:
        """Background loss minus target loss of the second word after the first."""
        counts = np.full((2, 2, len(first)), -1, np.int64)
        for side, word in enumerate((first, second)):
            for table in known:
                at, found = table.places(word)
                counts[side, 0, found], counts[side, 1, found] = table.n[at[found]], table.t[at[found]]
        if (counts < 0).any():
            raise RuntimeError("A document has a word that was not counted: its rows changed between two reads.")

        def loss(kind, times, total):
            context_n, word_n = counts[0, kind], counts[1, kind]
            weight = np.where(context_n > 0, BIGRAM, 0.0)
            # Add-one probabilities, with a place for words not seen, so that no word has none.
            return -np.log(weight * times / np.maximum(context_n, 1) + (1 - weight) * ((word_n + 1) / float(total + size + 1)))

        return loss(0, n, total_n) - loss(1, t, total_t)

    top = Known(answers.filter("bucket = -1").groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow())
    order = np.argsort(code)
    first, second = (frequent.column(i).to_numpy().view(np.uint64)[order] for i in (0, 1))
    shared = context.broadcast((top, values(first, second, top.n, top.t, top_words.value)))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packed(top_words.value, bucket_of_pair, buckets, TaskContext.get().partitionId())
        top, value = shared.value
        for batch, x, first, second, doc in pairs(batches, 2):
            at, found = top.places(pair_code(first, second))
            part = np.bincount(doc[found], value[at[found]] if len(value) else None, minlength=len(x.count)).astype(np.float64)
            if packed.held + len(first) > PACK or packed.docs + len(x.count) > PACK:
                yield from packed.take()
            packed.add(first[~found], second[~found], doc[~found], batch.column(0), flags_of(batch), x.count, part)
        yield from packed.take()

    back = ["block", "bucket", "value", *Packed.BLOCK, "ids"]

    def value_pairs(entries: pa.Table, table: pa.Table) -> pa.Table:
        """The values of each row's pairs; rows of blocks pass through."""
        mine = pc.is_valid(entries.column("ids"))
        own, entries = entries.filter(mine), entries.filter(pc.invert(mine))
        first, second, some_n, some_t, sizes = Packed.unpack(entries, top_words.value)
        value = np.zeros(len(first))
        if len(first):
            code = pair_code(first, second)
            order = np.argsort(code)
            edge = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            n, t = (np.add.reduceat(x[order], edge, dtype=np.int64) for x in (some_n, some_t))
            found = values(first[order[edge]], second[order[edge]], n, t, top_words.value, Known(table.select(["word", "n", "t"])))
            value[order] = np.repeat(found, np.diff(np.append(edge, len(order))))
        ends = np.cumsum(sizes)
        sent = pa.array([_squeezed(value[a:b]) for a, b in zip(ends - sizes, ends)], pa.binary())
        return pa.concat_tables([entries.append_column("value", sent).select(back),
                                 own.append_column("value", pa.nulls(own.num_rows, pa.binary())).select(back)])

    parts = (rows.select("doc_id", "is_target", "_bytes").mapInArrow(entries, Packed.schema(kind)).groupBy("bucket").cogroup(needed.groupBy("bucket"))
             .applyInArrow(value_pairs, "block bigint, bucket int, " + ", ".join(f"{n} binary" for n in back[2:-1]) + f", ids array<{kind}>"))
    return parts.groupBy("block").applyInArrow(valued, f"doc_id {kind}, n_tokens bigint, score double")
