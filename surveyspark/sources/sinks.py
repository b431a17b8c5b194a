"""Writers for report tables, guide, audit, comparisons and microdata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.runtime import compiled_methods


def _ordinal(column: str, values: Sequence[str]) -> Column:
    """Position in a declared order; other values come after it, as text."""
    chain = F.when(F.col(column) == values[0], 0)
    for position, value in enumerate(values[1:], 1):
        chain = chain.when(F.col(column) == value, position)
    return chain.otherwise(len(values))


def sheet_order(df: DataFrame) -> list[Column]:
    """Row order of a sheet: ages, sectors, heading group, then codes as text.

    The subtotal sits after its parts and the total comes last; genders are Male, Female, Persons.
    """
    order: list[Column] = []
    if "sheet" in df.columns:
        order.append(F.col("sheet"))
    for name, values in (("Age_group", list(cb.AGE_GROUPS)), ("Sector", [*cb.SECTORS, cb.POOLED_SECTOR])):
        if name in df.columns:
            order.append(_ordinal(name, values))
    for name in ("group_code", "group_label", *[c for c in ("Social_group", "Religion", "State_code") if c in df.columns]):
        if name in df.columns:
            order.append(F.col(name))
    code = next((c for c in ("Code", "code") if c in df.columns), None)
    if code:
        text = F.when(F.col(code) == "self", "2self").when(F.col(code) == cb.TOTAL_CODE, "~").otherwise(F.col(code))
        order.append(text)
    for name in ("Gender", "gender"):
        if name in df.columns:
            order.append(_ordinal(name, list(cb.GENDERS)))
    return order


def in_sheet_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*sheet_order(df))


def write_report(cells: DataFrame, path: str, kind: str = "parquet") -> None:
    """All sheets as one table partitioned by sheet; rows of a sheet in reading order."""
    # Finished cells only: one file per sheet.
    ordered = cells.repartition(F.col("sheet")).sortWithinPartitions(*sheet_order(cells))
    writer = ordered.write.mode("overwrite").partitionBy("sheet")
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown report kind: {kind}")


def write_small(df: DataFrame, path: str, kind: str) -> None:
    """Audit (``json``), guide and comparison (``csv``) tables: a few rows, one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    else:
        writer.option("header", True).csv(path)


def write_microdata(df: DataFrame, path: str, inputs: Sequence[str] = (), kind: str = "parquet") -> None:
    """The merged person table; never onto an input path."""
    target = path.rstrip("/")
    for source in inputs:
        source = source.rstrip("/")
        if target == source or source.startswith(target + "/") or target.startswith(source + "/"):
            raise ValueError(f"refusing to write onto the input path {source}")
    writer = df.write.mode("overwrite")
    with compiled_methods(df.sparkSession):
        if kind == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)


def first_rows(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by key (top-n, not a full sort)."""
    return df.select(*columns).orderBy(*key).limit(n)
