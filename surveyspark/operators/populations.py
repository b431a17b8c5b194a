"""Named populations, overlapping age groups and pooled sectors.

Populations and ages overlap, so they are memberships.  Rows keep one small integer with a bit per
age group; the groups themselves are spelled out only after aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import codebook as cb


def population(name: str) -> Column:
    """Predicate of a named population; an unknown name is an error."""
    worker, labour = F.col("Worker"), F.col("Labour_force")
    predicates = {
        "All persons": lambda: F.lit(True),
        "Workers": lambda: worker,
        "Labour force": lambda: labour,
        "Employees": lambda: F.col("Status_used").isin(*cb.EMPLOYEE_CODES),
        "Formal trainees in labour force": lambda: labour & (F.col("Training_code") == "1"),
        "Principal unemployed": lambda: F.col("Principal_status") == cb.SEEKING_CODE,
        "Unemployed": lambda: F.col("Unemployed"),
        "Non-workers": lambda: ~worker,
    }
    if name not in predicates:
        raise ValueError(f"unknown population: {name}")
    return F.coalesce(predicates[name](), F.lit(False))


def age_group(name: str) -> cb.AgeGroup:
    if name not in cb.AGE_GROUPS:
        raise ValueError(f"unknown age group: {name}")
    return cb.AGE_GROUPS[name]


def in_age_group(group: cb.AgeGroup, age: str = "Age") -> Column:
    """Inclusive at both ends; a missing age is in no group."""
    inside = F.col(age) >= group.lower
    if group.upper is not None:
        inside = inside & (F.col(age) <= group.upper)
    return F.coalesce(inside, F.lit(False))


def age_bits(ages: Sequence[cb.AgeGroup], age: str = "Age") -> Column:
    """One integer with bit i set for membership in ``ages[i]``."""
    bits = F.lit(0)
    for position, group in enumerate(ages):
        bits = bits + F.when(in_age_group(group, age), F.lit(1 << position)).otherwise(F.lit(0))
    return bits


def age_memberships(ages: Sequence[cb.AgeGroup], bits: str) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col(bits).bitwiseAND(1 << i) > 0, F.lit(g.name)) for i, g in enumerate(ages)]))


def sector_memberships(combined: bool | Column = True, sector: str = "Sector_code") -> Column:
    """The row's own sector, and the pooled view unless it has no meaning for the column."""
    own = [F.when(F.col(sector) == code, F.lit(name)) for name, code in cb.SECTORS.items()]
    pooled = F.when(combined if isinstance(combined, Column) else F.lit(combined), F.lit(cb.POOLED_SECTOR))
    return F.array_compact(F.array(*own, pooled))


def slices(df: DataFrame, ages: Sequence[str], population_name: str = "All persons",
           group: str | None = None, combined: bool = True) -> DataFrame:
    """Every row once per heading it belongs to: ``Age_group`` x ``Sector`` (x group).

    Meant for aggregated cells and for looking at memberships; the tabulators aggregate first.
    """
    groups = [age_group(a) for a in ages]
    rows = df.filter(population(population_name))
    if group is not None:
        rows = rows.filter(F.col(group).isNotNull())
    rows = rows.withColumn("__ages", age_bits(groups))
    return spread(rows, groups, combined)


def spread(cells: DataFrame, ages: Sequence[cb.AgeGroup], combined: bool | Column = True) -> DataFrame:
    """Spell out ``__ages`` and ``Sector_code`` as ``Age_group`` and ``Sector`` headings."""
    out = cells.withColumn("Age_group", F.explode(age_memberships(ages, "__ages")))
    out = out.withColumn("Sector", F.explode(sector_memberships(combined)))
    return out.drop("__ages")
