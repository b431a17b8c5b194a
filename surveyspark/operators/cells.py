"""Many tables over the same rows, as cells: partial sums in the tasks that hold the rows, then one small aggregation.

Spelling every row out once for each table makes dozens of short-lived rows of it.  Here a task counts some rows at a time, column by
column, and hands on cells; a cell is one row for each such chunk, and Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that a task counts at a time.
CHUNK = 1 << 17


@dataclass(frozen=True)
class Table:
    """Rows of ``people`` by ``code``, within ``group`` if there is one, whose age bits meet ``ages``; all by name."""

    people: str
    code: str
    group: str | None
    ages: int


def cell_sums(rows: DataFrame, tables: Sequence[Table], people: Mapping[str, Column], codes: Mapping[str, Column],
              ages: Column, sums: Mapping[str, Column], chunk: int = CHUNK) -> DataFrame:
    """``(table, ages, Sector_code, Gender, group, code, n, sums...)``: rows and sums of each cell; ``table`` is a place in ``tables``.

    Rows outside a table's people and ages, or without its code or group, are in none of its cells.  ``group`` is NULL in tables without one.
    A sum over NULLs alone is NULL.
    """
    flags = {name: f"p{i}" for i, name in enumerate(people)}
    texts = {name: f"c{i}" for i, name in enumerate(codes)}
    added = {name: f"s{i}" for i, name in enumerate(sums)}
    wide = rows.select(
        ages.cast("int").alias("a"), F.col("Sector_code").cast("string").alias("x"), F.col("Gender").cast("string").alias("y"),
        *[F.coalesce(people[n], F.lit(False)).alias(c) for n, c in flags.items()],
        *[codes[n].cast("string").alias(c) for n, c in texts.items()], *[sums[n].cast("double").alias(c) for n, c in added.items()])

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """A number for each row, 0 for NULL, and what the numbers stand for."""
        found = column.combine_chunks().dictionary_encode()
        return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, found.dictionary

    def named(numbers: np.ndarray, dictionary: pa.Array) -> pa.Array:
        return dictionary.take(pa.array(numbers - 1, mask=numbers == 0))

    def count(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {n: batch.column(n) for n in batch.column_names}
        bits = column["a"].to_numpy()
        x, sectors = coded(column["x"])
        y, genders = coded(column["y"])
        flag = {n: column[c].to_numpy() for n, c in flags.items()}
        text = {n: coded(column[c]) for n, c in texts.items()}
        known = [pc.is_valid(column[c]).to_numpy() for c in added.values()]
        value = [pc.fill_null(column[c], 0.0).to_numpy() for c in added.values()]
        for number, t in enumerate(tables):
            code, names = text[t.code]
            age = bits & t.ages
            use = flag[t.people] & (code > 0) & (age > 0)
            group, groups = text[t.group] if t.group else (None, None)
            if t.group:
                use = use & (group > 0)
            use = np.flatnonzero(use)
            if not len(use):
                continue
            parts = [(age, t.ages + 1), (x, len(sectors) + 1), (y, len(genders) + 1), *([(group, len(groups) + 1)] if t.group else []), (code, len(names) + 1)]
            key = np.zeros(len(use), np.int64)
            for part, size in parts:
                key = key * size + part[use]
            cells, place = np.unique(key, return_inverse=True)
            out, rest = [], cells
            for _, size in reversed(parts):
                out.append(rest % size)
                rest = rest // size
            out.reverse()
            n = np.bincount(place)
            arrays = [pa.array(np.full(len(cells), number), pa.int32()), pa.array(out[0], pa.int32()), named(out[1], sectors), named(out[2], genders),
                      named(out[3], groups) if t.group else pa.nulls(len(cells), pa.string()), named(out[-1], names), pa.array(n, pa.int64())]
            for ok, v in zip(known, value):
                arrays.append(pa.array(np.bincount(place, v[use], len(cells)), mask=np.bincount(place, ok[use], len(cells)) == 0))
            yield pa.RecordBatch.from_arrays(arrays, names=["table", "ages", "Sector_code", "Gender", "group", "code", "n", *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield from count(pa.Table.from_batches(held))
                held = []
        if held:
            yield from count(pa.Table.from_batches(held))

    kinds = "table int, ages int, Sector_code string, Gender string, group string, code string, n bigint"
    found = wide.mapInArrow(run, ", ".join([kinds, *[f"{c} double" for c in added.values()]]))
    return found.groupBy("table", "ages", "Sector_code", "Gender", "group", "code").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(n) for n, c in added.items()])
