"""Column expressions that turn codes and amounts into categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.runtime import small_table


def clean_text(column: Column | str) -> Column:
    """Trim; an empty answer becomes NULL.  The text ``NA`` is an answer like any other."""
    return F.nullif(F.trim(_col(column)), F.lit(""))


def strict_number(column: Column | str, kind: str = "double") -> Column:
    """Cast text to a number and stop the job on text that is not one, in any ANSI setting."""
    text = _col(column)
    number = text.try_cast(kind)
    bad = text.isNotNull() & number.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), text))).otherwise(number)


def band_code(value: Column | str, bands: Sequence[cb.Band], else_null: bool = False) -> Column:
    """Code of the inclusive band holding ``value``; otherwise the code itself, or NULL.

    One array lookup, whatever the number of bands.
    """
    original = _col(value).cast("string")
    table = [None] * (max(b.upper for b in bands) + 1)
    for band in bands:
        table[band.lower:band.upper + 1] = [band.code] * (band.upper + 1 - band.lower)
    found = F.get(F.array(*[F.lit(code).cast("string") for code in table]), strict_number(original, "int"))
    return found if else_null else F.coalesce(found, original)


def bin_code(amount: Column | str, upper_bounds: Sequence[float], start: int = 1) -> Column:
    """Right-closed bins over nonnegative amounts, numbered as text; negatives give NULL."""
    amount = _col(amount)
    chain = F.when(amount.isNull() | (amount < 0), F.lit(None).cast("string"))
    for code, bound in enumerate(upper_bounds, start):
        chain = chain.when(amount <= bound, F.lit(str(code)))
    return chain.otherwise(F.lit(str(start + len(upper_bounds))))


def code_prefix(column: Column | str, width: int) -> Column:
    return F.substring(_col(column), 1, width)


def two_sided_dummy(column: Column | str, one, zero) -> Column:
    """1 / 0 for the two named codes, NULL for any other."""
    column = _col(column)
    return F.when(column == one, 1).when(column == zero, 0)


def plain_dummy(condition: Column) -> Column:
    """1 / 0 with NULL counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def indicator_percent(flag: Column, among: Column | None = None) -> Column:
    """100 or 0, and NULL outside the denominator, so that a weighted mean is a percentage."""
    value = 100.0 * F.coalesce(flag, F.lit(False)).cast("int")
    return value if among is None else F.when(among, value)


def comparison_group(first: Column, second: Column) -> Column:
    """1 for the first group, 2 for the second, NULL for everybody else."""
    return F.when(first, 1).when(second, 2)


def label_table(spark: SparkSession, labels: Mapping[str, Mapping[str, str]] = cb.LABELS) -> DataFrame:
    """All value labels as ``(domain, code, label)``; its size is that of the codebook."""
    rows = [(domain, code, label) for domain, codes in labels.items() for code, label in codes.items()]
    return small_table(spark, rows, "domain string, code string, label string")


def with_label(df: DataFrame, column: str, domain: str, name: str,
               labels: Mapping[str, Mapping[str, str]] = cb.LABELS) -> DataFrame:
    """Left join one label domain; a code without a label is shown as itself."""
    table = label_table(df.sparkSession, {domain: labels.get(domain, {})})
    table = table.select(F.col("code").alias("__code"), F.col("label").alias("__label"))
    joined = df.join(table, F.col(column).cast("string") == F.col("__code"), "left")
    return joined.withColumn(name, F.coalesce("__label", F.col(column).cast("string"))).drop("__code", "__label")


def attach_metadata(df: DataFrame, texts: Mapping[str, str],
                    labels: Mapping[str, Mapping[str, str]] = cb.LABELS) -> DataFrame:
    """Keep a variable label and the value labels with the column itself."""
    changed = {}
    for column in df.columns:
        if column in texts or column in labels:
            note = {"comment": texts.get(column, column), "value_labels": dict(labels.get(column, {}))}
            changed[column] = F.col(column).alias(column, metadata=note)
    return df.withColumns(changed) if changed else df


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
