"""Declared data checks: one aggregate per table, however many checks there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import codebook as cb


class CheckFailed(ValueError):
    """Raised in strict mode after every check has been counted."""


@dataclass(frozen=True)
class Check:
    """``holds`` must be true on every row; NULL counts as a violation."""

    name: str
    holds: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


def check_report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``(check, violations)`` from a single pass; the result has one row per check."""
    counted = df.agg(*[F.count_if(c.broken).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(checks)]
    return counted.select(F.inline(F.array(*rows)))


def counters(checks: Sequence[Check]) -> dict[str, Column]:
    """Violation counts by check name, to be observed while the rows are written."""
    return {c.name: F.count_if(c.broken) for c in checks}


def refuse(counts: Mapping[str, int], strict: bool = True) -> None:
    """In strict mode raise with every check that is broken in ``counts``."""
    failed = sorted((name, n) for name, n in counts.items() if n)
    if strict and failed:
        raise CheckFailed("; ".join(f"{name}: {n:,} rows" for name, n in failed))


def violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The offending rows, each with the names of the checks it breaks.

    A filter on the names would be moved below them and evaluate every check, and all that it is derived from, once more.
    """
    names = F.array_compact(F.array(*[F.when(c.broken, F.lit(c.name)) for c in checks]))
    broken = F.filter(F.array("failed_checks"), lambda found: F.size(found) > 0)
    return df.withColumn("failed_checks", names).select(*df.columns, F.explode(broken).alias("failed_checks"))


def enforce(*reports: DataFrame, strict: bool = True) -> list[tuple[str, int]]:
    """Evaluate small ``(check, violations)`` reports; in strict mode raise with every failure."""
    failures: list[tuple[str, int]] = []
    for report in reports:
        failures += [(r["check"], r["violations"]) for r in report.filter("violations > 0").collect()]
    if strict and failures:
        raise CheckFailed("; ".join(f"{name}: {count:,} rows" for name, count in sorted(failures)))
    return failures


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values on more than one row, with their row counts (counted map-side first)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def key_report(df: DataFrame, key: Sequence[str], name: str | None = None) -> DataFrame:
    """How many rows have a NULL in the key, and how many key values repeat."""
    name = name or "+".join(key)
    any_null = F.lit(False)
    for column in key:
        any_null = any_null | F.col(column).isNull()
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
    counted = groups.agg(
        F.coalesce(F.sum(F.when(any_null, F.col("__rows"))), F.lit(0)).alias("n"),
        F.count_if((F.col("__rows") > 1) & ~any_null).alias("d"),
    )
    return counted.select(F.inline(F.array(
        F.struct(F.lit(f"{name} missing").alias("check"), F.col("n").alias("violations")),
        F.struct(F.lit(f"{name} repeated").alias("check"), F.col("d").alias("violations")),
    )))


# --- the survey's own checks -------------------------------------------------------------------

def key_part_checks(suffix: str, parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> list[Check]:
    """Every part present, of its exact width and in its domain."""
    return [
        Check(f"{p.prefix}_{suffix}",
              (F.length(f"{p.prefix}_{suffix}") == p.width) & F.col(f"{p.prefix}_{suffix}").rlike(f"^(?:{p.pattern})$"))
        for p in parts
    ]


def serial_check(column: str) -> Check:
    return Check(f"{column} two digits", F.col(column).rlike("^[0-9]{2}$"))


def weight_checks() -> list[Check]:
    fields = ("NSS", "NSC", "Multiplier", "Contributing_quarters")
    checks = [Check(f"{f} finite and positive", _finite(f) & (F.col(f) > 0)) for f in fields]
    checks.append(Check("Contributing_quarters in 1-4", F.col("Contributing_quarters").isin(1, 2, 3, 4)))
    return checks


def final_weight_check(weight: str = "Weight") -> Check:
    return Check(f"{weight} finite and positive", _finite(weight) & (F.col(weight) > 0))


def person_checks() -> list[Check]:
    return [
        Check("Age nonnegative", F.col("Age") >= 0),
        Check("Gender_original in 1-3", F.col("Gender_original").isin("1", "2", "3")),
        Check("Sector_code in 1-2", F.col("Sector_code").isin("1", "2")),
    ]


def activity_checks() -> list[Check]:
    principal = (*cb.WORK_CODES, cb.SEEKING_CODE, *cb.OUTSIDE_CODES)
    return [
        Check("Principal_status documented", F.col("Principal_status").isin(*principal)),
        Check("Subsidiary_status documented",
              F.col("Subsidiary_status").isNull() | F.col("Subsidiary_status").isin(*cb.WORK_CODES)),
    ]


def household_code_checks() -> list[Check]:
    return [
        Check("Social_group documented", F.col("Social_group").isin(*cb.LABELS["Social_group"])),
        Check("Religion documented", F.col("Religion").isin(*cb.LABELS["Religion"])),
    ]


def flag_checks() -> list[Check]:
    worker, labour, seeking = (F.col(c).cast("int") for c in ("Worker", "Labour_force", "Unemployed"))
    return [
        Check("Worker implies Labour_force", worker <= labour),
        Check("Worker plus Unemployed is Labour_force", worker + seeking == labour),
        Check("Broad_status exactly for workers", F.col("Broad_status").isNotNull() == F.col("Worker")),
    ]


def selected_job_checks() -> list[Check]:
    idle = ~F.col("Worker")
    return [
        Check("NIC of a worker has 5 digits", idle | F.col("NIC").rlike("^[0-9]{5}$")),
        Check("NCO of a worker has 3 digits", idle | F.col("NCO").rlike("^[0-9]{3}$")),
        Check("NIC division of a worker documented", idle | F.col("NIC_broad").isin(*cb.LABELS["NIC_broad"])),
    ]


def benefit_checks() -> list[Check]:
    benefit = F.col("Social_security")
    employee = F.coalesce(F.col("Status_used").isin(*cb.EMPLOYEE_CODES), F.lit(False))
    return [
        Check("Social_security in 1-9 or blank", benefit.isNull() | benefit.isin(*cb.LABELS["Social_security"])),
        Check("Social_security blank for others than employees", employee | benefit.isNull()),
    ]


def recode_checks() -> list[Check]:
    """Walkthrough rules that are stricter than the report run."""
    spending = F.col("Household_monthly_spending")
    return [
        Check("Attendance_code in a documented band",
              F.col("Attendance_code").isNull() | F.col("Attendance_group").isin(*cb.LABELS["Attendance_group"])),
        Check("Household_monthly_spending nonnegative", spending.isNull() | (spending >= 0)),
    ]


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
