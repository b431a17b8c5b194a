"""Removal of bytes that repeat an earlier document, by blockwise suffix sorting with a cover sample.

A byte of a document goes if it lies in a string of ``length`` bytes that also starts in a document
with a smaller doc_id.

Sorting every suffix of a corpus costs many times its size in shuffled data, so the difference cover
is taken from the content: of the hashes of the ``SEED``-byte strings that start in each window of
``length - SEED + 1`` positions, the smallest marks a *cover position*.  Two equal strings of ``length`` bytes
have a cover position at the same place, which is the property that a cover sample is needed for.

1. Count: one bucket of cover positions at a time shows which strings of ``SEED`` bytes occur under two
   doc_ids, and which of their surroundings (the bytes of all strings that belong to the position) are
   equal.  Whatever lies in surroundings that an earlier document has, too, goes.
2. Sort: of surroundings that remain, one document each, one suffix bucket at a time is sorted as bytes,
   right and left of the cover position, and ranked, with the common lengths of neighbours.
3. Resolve: a string that starts ``i`` bytes before its cover position equals another one exactly if the
   right contexts share a rank at depth ``length - i`` and the left contexts share one at depth ``i``.
   So the long ties of all strings come from ranks of the sample; no string is compared whole.

Buckets follow ``spark.sql.shuffle.partitions``; a bucket's memory is that of its cover positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import text as tx

LENGTH = 50
SEED = 20
LAST = (1 << 63) - 1


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` entries."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def owned(data: np.ndarray, offsets: np.ndarray, length: int, seed: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, low, high, surroundings): cover positions, the string starts that belong to each, and the
    hash of the bytes from ``low`` to ``high + length``.

    A string belongs to the leftmost smallest hash in it.  Strings lie within one document.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    prefix = tx.prefix_hash(data)
    n = len(data) - seed + 1
    _, down = tx.powers(len(prefix))
    h = tx.mix((prefix[seed:] - prefix[:-seed]) * down[:n]) | np.uint64(1)
    least = _slide(h, length - seed + 1, np.minimum)
    cross = (offsets[1:, None] - np.arange(1, length)[None, :]).ravel()
    valid = np.ones(len(least), bool)
    valid[cross[(cross >= 0) & (cross < len(least))]] = False
    start = np.flatnonzero(valid)
    # The leftmost place from each start on that has the window's smallest hash.
    value = least[start]
    changed = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(start) > 1)])) \
        if len(start) else start
    run_end = np.append(changed[1:], len(start))
    # Within a run of starts with one smallest hash the place is the same, unless the hash itself repeats.
    first = start[changed]
    place = first.copy()
    todo = np.arange(len(first))
    wanted = value[changed]
    while len(todo):
        todo = todo[h[place[todo]] != wanted[todo]]
        place[todo] += 1
    low, high, position = first, start[run_end - 1], place
    late = np.flatnonzero(high > position)
    if len(late):
        # The hash stands again further on: cut these runs start by start.
        more = [(k, s) for k in late for s in range(position[k] + 1, high[k] + 1)]
        high = high.copy()
        high[late] = position[late]
        begin = np.array([s for _, s in more], np.int64)
        goal = np.array([wanted[k] for k, _ in more], np.uint64)
        spot = begin.copy()
        todo = np.arange(len(begin))
        while len(todo):
            todo = todo[h[spot[todo]] != goal[todo]]
            spot[todo] += 1
        edge = np.flatnonzero(np.diff(spot, prepend=-1))
        low = np.concatenate([low, begin[edge]])
        high = np.concatenate([high, begin[np.append(edge[1:], len(begin)) - 1]]) if len(edge) else high
        position = np.concatenate([position, spot[edge]])
        order = np.argsort(position, kind="stable")
        low, high, position = low[order], high[order], position[order]
    around = tx.span_hash(prefix, low, high + length) + (position - low).astype(np.uint64)
    return position, h[position], low, high, around


def six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits as rows of six bytes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def of_six(table: pa.Table, name: str) -> np.ndarray:
    rows = tx.unpack(table, name, np.uint8).reshape(-1, 6)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :6] = rows
    return out.view("<u8").ravel()


_LOW = np.uint64((1 << 48) - 1)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Smallest hashes of windows are small numbers: by their own size, most of them would fall into the first tenth of the buckets."""
    return tx.bucket_of(tx.mix(h), buckets)


def ticket(h: np.ndarray, around: np.ndarray, compare: np.ndarray | bool) -> np.ndarray:
    """What a document is told of one of its cover positions: drop it, or compare its surroundings."""
    key = tx.mix(tx.mix(h & _LOW) + (around & _LOW))
    return (key & ~np.uint64(1)) | np.asarray(compare).astype(np.uint64)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def rows_of(docs: DataFrame) -> DataFrame:
    """row_id (NULL doc_id last), row_hash and bytes of each row."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("row_id"), F.xxhash64("text").alias("row_hash"),
                       tx.utf8().alias("_bytes"))


def squeezed(rows: DataFrame) -> DataFrame:
    """The bytes compressed for the shuffle."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                small = [packer.compress(x.as_buffer()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(small, pa.binary())], names=part.schema.names)

    return rows.mapInArrow(run, kinds)


def unsqueezed(batches: Iterator[pa.RecordBatch], at: int, rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB with the column at ``at`` expanded again."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            data = pa.array([opener.decompress(x.as_buffer()) for x in part.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [data if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)


COVER = ["hash", "around", "row_id"]


def covers(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """Packed by bucket: hash, surroundings and row_id of every cover position."""
    buckets = tx.n_buckets(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = tx.Blobs(buckets, COVER, planes=["row_id"])
        for batch, data, offsets in tx.chunks(batches, "_bytes"):
            ids = batch.column(0).to_numpy()
            position, h, _, _, around = owned(data, offsets, length, seed)
            row = ids[np.searchsorted(offsets, position, "right") - 1]
            blobs.add(bucket_of(h, buckets), six(h), six(around), row)
            if blobs.full():
                yield blobs.take()
        if (rest := blobs.take()) is not None:
            yield rest

    return rows.select("row_id", "_bytes").mapInArrow(emit, tx.Blobs(buckets, COVER).schema())


def tickets(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(row_id, ticket) of the cover positions that another doc_id has, too."""

    def meet(table: pa.Table) -> pa.Table:
        h, around, row = of_six(table, "hash"), of_six(table, "around"), tx.unpack_planes(table, "row_id", np.int64)
        order = np.argsort(h)
        edge = _edges(h[order])
        size = np.diff(np.append(edge, len(h)))
        if len(h):
            ranked = row[order]
            several = np.minimum.reduceat(ranked, edge) != np.maximum.reduceat(ranked, edge)
            order = order[np.repeat(several, size)]
        h, around, row = h[order], around[order], row[order]
        order = np.lexsort((row, around, h))
        h, around, row = h[order], around[order], row[order]
        keep = _edges(h, around, row)
        h, around, row = h[keep], around[keep], row[keep]
        edge = _edges(h, around)
        first = np.zeros(len(h), bool)
        first[edge] = True
        # Surroundings that no other ones of the same hash stand beside need no comparison.
        group = np.cumsum(np.isin(np.arange(len(h)), _edges(h))) - 1
        kinds = np.bincount(group[edge], minlength=1) if len(h) else np.zeros(1, np.int64)
        use = ~first | (kinds[group] > 1) if len(h) else first
        return pa.table({"row_id": row[use], "ticket": ticket(h[use], around[use], first[use]).view(np.int64)})

    return covers(rows, length, seed).groupBy("bucket").applyInArrow(meet, "row_id bigint, ticket bigint")


WIDE = ["row_id", "row_hash", "position", "before", "after", "bytes"]
DONE = ["done_id", "done_hash", "first", "last"]
PLANES = ["row_id", "position", "done_id", "first", "last"]


def contexts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """Packed by bucket: surroundings to compare, and byte ranges that are known to go."""
    buckets = tx.n_buckets(rows)
    reach = length - seed
    schema = "bucket int, " + ", ".join(f"{x} binary" for x in WIDE + DONE)
    shape = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in WIDE + DONE])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, done = tx.Blobs(buckets, WIDE, 100_000, PLANES), tx.Blobs(buckets, DONE, 300_000, PLANES)

        def out(blobs):
            batch = blobs.take()
            if batch is not None:
                columns = [batch.column(x) if x in batch.schema.names else pa.nulls(batch.num_rows, pa.binary())
                           for x in shape.names]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

        for batch, data, offsets in tx.chunks(unsqueezed(batches, 2), "_bytes"):
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            given = batch.column(3)
            sizes = np.diff(given.offsets.to_numpy())
            known = given.flatten().to_numpy().view(np.uint64) + np.repeat(
                tx.mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(7)), sizes)
            position, h, low, high, around = owned(data, offsets, length, seed)
            doc = np.searchsorted(offsets, position, "right") - 1
            salt = tx.mix(doc.astype(np.uint64) + np.uint64(7))
            gone = np.isin(ticket(h, around, False) + salt, known)
            if gone.any():
                a, b, d = low[gone], high[gone] + length, doc[gone]
                order = np.argsort(a, kind="stable")
                a, b, d = a[order], b[order], d[order]
                reached = np.maximum.accumulate(b)
                new = np.concatenate([[True], (a[1:] > reached[:-1]) | (d[1:] != d[:-1])])
                at = np.flatnonzero(new)
                b = np.maximum.reduceat(b, at)
                a, d = a[at], d[at]
                done.add(np.abs(ids[d]) % buckets, ids[d], hashes[d], a - offsets[d], b - offsets[d])
            use = np.isin(ticket(h, around, True) + salt, known)
            if use.any():
                position, h, low, high, doc = position[use], h[use], low[use], high[use], doc[use]
                padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
                window = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + seed)[position]
                # Bytes that none of the position's strings has would only make the blobs larger.
                column = np.arange(2 * reach + seed)[None, :]
                unused = (column < (reach - (position - low))[:, None]) | (column >= (reach + length - (position - high))[:, None])
                window = np.where(unused, np.uint8(0), window)
                wide.add(bucket_of(h, buckets), ids[doc], hashes[doc], position - offsets[doc],
                         (position - low).astype(np.uint8), (position - high).astype(np.uint8), window)
            if wide.full():
                yield from out(wide)
            if done.full():
                yield from out(done)
        yield from out(wide)
        yield from out(done)

    return rows.mapInArrow(emit, schema)


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row in byte order, bytes that each ranked row shares with the one before)."""
    width = rows.shape[1]
    # Words of eight bytes, most significant first, sort as the bytes do.
    key = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    key[:, :width] = rows
    key = key.view(">u8").astype(np.uint64)
    order = np.lexsort(key.T[::-1])
    del key
    common = np.zeros(len(rows), np.int64)
    # Some rows at a time, so that no second copy of all of them is held.
    for lo in range(1, len(rows), 1 << 16):
        hi = min(lo + (1 << 16), len(rows))
        differs = rows[order[lo:hi]] != rows[order[lo - 1:hi - 1]]
        common[lo:hi] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    return rank, common


def repeated(row_id: np.ndarray, before: np.ndarray, after: np.ndarray, window: np.ndarray, length: int, seed: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """(entry, i): strings that start i bytes before the entry's cover position and also start in a smaller row_id."""
    reach = length - seed
    right_rank, right_common = _ranked(window[:, reach:])
    left_rank, left_common = _ranked(np.ascontiguousarray(window[:, :reach][:, ::-1]))
    entries, shifts = [], []
    for i in range(int(before.max(initial=-1)) + 1):
        use = np.flatnonzero((after <= i) & (i <= before))
        if not len(use):
            continue
        right = np.cumsum(right_common < length - i)[right_rank[use]]
        left = np.cumsum(left_common < i)[left_rank[use]] if i else np.zeros(len(use), np.int64)
        pair = right * (len(window) + 2) + left
        order = np.argsort(pair)
        pair = pair[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        least = np.minimum.reduceat(row_id[use][order], edge)
        least = np.repeat(least, np.diff(np.append(edge, len(pair))))
        hit = use[order[least < row_id[use][order]]]
        entries.append(hit)
        shifts.append(np.full(len(hit), i))
    if not entries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(entries), np.concatenate(shifts)


def removed_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row_id, row_hash, first, last): byte ranges that go; ranges of one document may overlap."""
    reach = length - seed
    rows = rows_of(docs)
    told = tickets(rows, length, seed).groupBy("row_id").agg(F.collect_list("ticket").alias("tickets"))
    packed = contexts(squeezed(rows).join(told.hint("shuffle_hash"), "row_id")
                      .select("row_id", "row_hash", "_bytes", "tickets"), length, seed)

    def sort(table: pa.Table) -> pa.Table:
        row_id, row_hash = tx.unpack_planes(table, "row_id", np.int64), tx.unpack(table, "row_hash", np.int64)
        position = tx.unpack_planes(table, "position", np.int64)
        before, after = (tx.unpack(table, x, np.uint8).astype(np.int64) for x in ("before", "after"))
        window = tx.unpack(table, "bytes", np.uint8).reshape(-1, 2 * reach + seed)
        entry, shift = repeated(row_id, before, after, window, length, seed)
        start = position[entry] - shift
        row_id, row_hash = row_id[entry], row_hash[entry]
        order = np.lexsort((start, row_hash, row_id))
        row_id, row_hash, start = row_id[order], row_hash[order], start[order]
        # Starts that overlap or touch make one range.
        edge = np.zeros(len(start), bool)
        edge[:1] = True
        edge[1:] = (row_id[1:] != row_id[:-1]) | (row_hash[1:] != row_hash[:-1]) | (start[1:] > start[:-1] + length)
        edge = np.flatnonzero(edge)
        last = start[np.append(edge[1:], len(start)) - 1] + length if len(start) else start
        known = [(tx.unpack_planes if x in PLANES else tx.unpack)(table, x, np.int64) for x in DONE]
        mine = [row_id[edge], row_hash[edge], start[edge], last]
        return pa.table({x: np.concatenate([a, b]) for x, a, b in zip(("row_id", "row_hash", "first", "last"), known, mine)})

    return (packed.groupBy("bucket")
            .applyInArrow(sort, "row_id bigint, row_hash bigint, first bigint, last bigint"))


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each row of ``docs`` (doc_id, text).

    A NULL text is empty.  A NULL doc_id comes after all others; rows with one doc_id do not remove
    anything from each other.  Texts shorter than ``length`` stay whole.  Bytes that remain need not be
    valid UTF-8.  An empty table gives no rows.
    """
    spans = (removed_spans(docs, length, seed).groupBy("row_id", "row_hash")
             .agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")))
    source = squeezed(docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("row_id"), F.xxhash64("text").alias("row_hash"),
        tx.utf8().alias("_bytes")))
    joined = (source.join(spans.hint("shuffle_hash"), ["row_id", "row_hash"], "left")
              .select("doc_id", "first", "last", "_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unsqueezed(batches, 3):
            size, removed, runs, kept = [], [], [], []
            for first, last, data in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                if first.is_valid and len(first):
                    np.add.at(gone, first.values.to_numpy(), 1)
                    np.add.at(gone, last.values.to_numpy(), -1)
                mask = np.cumsum(gone)[:-1] > 0
                size.append(len(raw))
                removed.append(int(mask.sum()))
                runs.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                kept.append(raw[~mask].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
