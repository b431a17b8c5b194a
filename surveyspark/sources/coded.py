"""Readers for coded survey files: everything arrives as text and keeps its leading zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from surveyspark import codebook as cb
from surveyspark.functions.recode import clean_text


class BadInput(ValueError):
    """A file is missing, lacks a column or holds no records."""


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise BadInput(f"{name} lacks the columns {', '.join(absent)}")


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise BadInput(f"{name} has no records")
    return df


def _csv(spark: SparkSession, path: str) -> DataFrame:
    try:
        raw = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"')
               .option("escape", '"').option("nullValue", "").option("enforceSchema", False).csv(path))
    except AnalysisException as error:
        raise BadInput(f"cannot read {path}") from error
    return raw.withColumnsRenamed({c: c.lstrip("\ufeff") for c in raw.columns if c.startswith("\ufeff")})


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise BadInput(f"cannot read {path}") from error


def read_coded_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of a headed CSV as trimmed text; blanks become NULL, ``NA`` stays text.

    Columns are selected by header name.  A byte-order mark and CRLF line ends are accepted.
    """
    return _clean(_csv(spark, path), columns, path)


def read_all_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All columns of a headed CSV, read like :func:`read_coded_csv`."""
    return _all(_csv(spark, path), required, path)


def read_all_prepared(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All columns of a prepared Parquet table, as text."""
    return _all(_parquet(spark, path), required, path)


def _all(raw: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    require_columns(raw, required, name)
    return _clean(raw, raw.columns, name)


def read_prepared(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The same columns from a prepared Parquet table."""
    return _clean(_parquet(spark, path), columns, path)


def _clean(raw: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    require_columns(raw, columns, name)
    return require_rows(raw.select(*[clean_text(raw[c].cast("string")).alias(c) for c in columns]), name)


def person_columns(key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS, wages: bool = False) -> list[str]:
    return [f"{p.prefix}_perv1" for p in key_parts] + list(cb.PERSON_FIELDS) + (list(cb.WAGE_FIELDS) if wages else [])


def household_columns(key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> list[str]:
    return ([f"{p.prefix}_hhv1" for p in key_parts] + list(cb.HOUSEHOLD_FIELDS)
            + [household for _, household in cb.AGREEMENT_FIELDS])


def read_first_visit_files(spark: SparkSession, data_dir: str, kind: str = "csv",
                           wages: bool = False) -> tuple[DataFrame, DataFrame]:
    """Persons and households of the first visit, with exactly the declared columns."""
    base = data_dir.rstrip("/")
    if kind == "csv":
        return (read_coded_csv(spark, f"{base}/perv1.csv", person_columns(wages=wages)),
                read_coded_csv(spark, f"{base}/hhv1.csv", household_columns()))
    if kind == "parquet":
        return (read_prepared(spark, f"{base}/perv1.parquet", person_columns(wages=wages)),
                read_prepared(spark, f"{base}/hhv1.parquet", household_columns()))
    raise ValueError(f"unknown file kind: {kind}")


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Page texts of a published report as ``(page_no, text)``."""
    pages = spark.read.parquet(path)
    require_columns(pages, ["page_no", "text"], path)
    return pages.select("page_no", "text")
