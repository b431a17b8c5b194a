"""The historical report tables, compiled from specifications into one pass over the prepared rows.

A table is the share of each code of one column, within a slice (age group, sector, gender) and perhaps a group.  Cross-tabs with row
or column percents, one-way tables, and means of 0/100 indicators are all of this form.  The tasks that hold
the rows turn them into cells of all tables, with both weights side by side, and only cells are repeated for pooled
sectors, genders and groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import recode, status
from surveyspark.operators import cells as cl
from surveyspark.operators import tabulate as tb
from surveyspark.operators.populations import age_bits, age_group, age_memberships, population, sector_memberships

WEIGHTS = {"historical": "Weight", "annual": "Annual_weight"}
PERSONS, ALL_GROUPS = "Persons", "Total"


@dataclass(frozen=True)
class ReportTable:
    """``column`` is tabulated within slices of ``people``, and within ``group`` if there is one.

    ``pooled`` adds Rural + Urban, ``total`` all groups together, ``running`` cumulative percents; ``only`` keeps one code, which makes a
    flag's share a rate.
    """

    name: str
    column: str
    people: str = "Labour force"
    ages: tuple[str, ...] = ("15+",)
    group: str | None = None
    total: bool = True
    pooled: bool = True
    running: bool = False
    only: str | None = None


_ALL = ("All ages",)
_BOTH = ("All ages", "15+")

# The historical script's tables.
TABLES: tuple[ReportTable, ...] = (
    ReportTable("lfpr_social_group", "In_labour_force", "All persons", _ALL, "Social_group", only="1"),
    ReportTable("wpr_social_group", "At_work", "All persons", _ALL, "Social_group", only="1"),
    ReportTable("ur_social_group", "Seeking", "Labour force", _ALL, "Social_group", only="1"),
    ReportTable("lfpr_state_youth", "In_labour_force", "All persons", ("15-29",), "State_code", only="1"),
    ReportTable("labour_force_social_group", "In_labour_force", "All persons", _ALL, "Social_group"),
    ReportTable("industry_division", "Industry", "Labour force", _ALL),
    ReportTable("industry_broad", "Industry_broad", "Labour force", _ALL),
    ReportTable("industry_three", "Industry_three", "Labour force", _ALL),
    ReportTable("status_industry_broad", "Status", "Labour force", _BOTH, "Industry_broad"),
    ReportTable("status_industry_three", "Status", "Labour force", _BOTH, "Industry_three"),
    ReportTable("status_labour_force", "Status", "Labour force", _ALL),
    ReportTable("status_everybody", "Status", "All persons"),
    ReportTable("training_everybody", "Training_code", "All persons", ("15-59",), running=True),
    ReportTable("training_labour_force", "Training_code", running=True),
    ReportTable("occupation_group", "Occupation", "Labour force", _BOTH),
    ReportTable("occupation_division", "Occupation_division"),
    ReportTable("occupation_subdivision", "Occupation_subdivision"),
    ReportTable("benefits", "Benefits"),
    ReportTable("status_social_group", "Status", group="Social_group", total=False),
    ReportTable("status_religion", "Status", group="Religion", total=False),
    ReportTable("household_type", "Household_type", pooled=False),
    ReportTable("religion", "Religion"),
    ReportTable("social_group", "Social_group"),
    ReportTable("spending_band", "Household_spending_band"),
    ReportTable("marital_status", "Marital_status"),
    ReportTable("attendance", "Attendance_group"),
    ReportTable("training_field", "Training_field"),
    ReportTable("training_duration", "Training_duration"),
    ReportTable("training_type", "Training_type"),
    ReportTable("activity_duration", "Months"),
    ReportTable("search_efforts", "Efforts_to_find_work"),
    ReportTable("unemployment_spell", "Unemployment_duration"),
    ReportTable("reason_not_working", "Reason_not_working"),
)


def historical_columns(prepared: DataFrame) -> DataFrame:
    """Columns of the historical script: job details are the first that are not blank, status cascades."""
    def flag(column: str) -> Column:
        return F.col(column).cast("int").cast("string")

    rows = prepared.withColumns({
        "Status": status.cascaded_broad_status(),
        "Industry": recode.code_prefix(status.first_nonblank("NIC_principal", "NIC_subsidiary"), 2),
        "Occupation": status.first_nonblank("NCO_principal", "NCO_subsidiary"),
        "Benefits": status.first_nonblank("Security_principal", "Security_subsidiary"),
        "Months": status.first_nonblank("Economic_months_principal", "Economic_months_subsidiary"),
        "In_labour_force": flag("Labour_force"), "At_work": flag("Worker"), "Seeking": flag("Unemployed"),
    })
    return rows.withColumns({
        "Industry_broad": recode.band_code("Industry", cb.NIC_BROAD_BANDS), "Industry_three": recode.band_code("Industry", cb.NIC_THREE_BANDS),
        "Occupation_division": recode.code_prefix("Occupation", 1), "Occupation_subdivision": recode.code_prefix("Occupation", 2),
    })


def base_cells(prepared: DataFrame, tables: Sequence[ReportTable] = TABLES, weights: Mapping[str, str] = WEIGHTS) -> DataFrame:
    """Rows and weights by (table, age bits, sector, gender, group, code): the only pass over the rows."""
    ages = [age_group(a) for a in dict.fromkeys(a for t in tables for a in t.ages)]
    position = {g.name: i for i, g in enumerate(ages)}
    rows = historical_columns(prepared).filter(F.col("Sector_code").isin(*cb.SECTORS.values()))
    return cl.cell_sums(
        rows, [cl.Table(t.people, t.column, t.group, sum(1 << position[a] for a in t.ages)) for t in tables],
        {t.people: population(t.people) for t in tables}, {c: F.col(c) for t in tables for c in (t.column, t.group) if c}, age_bits(ages),
        {f"w{i}": F.col(w) for i, w in enumerate(weights.values())}).withColumnRenamed("ages", "__ages")


def report_tables(prepared: DataFrame, tables: Sequence[ReportTable] = TABLES, weights: Mapping[str, str] = WEIGHTS) -> DataFrame:
    """``(table, Age_group, Sector, Gender, group, code, weighting, n, percent, running)``.

    ``group`` is NULL for tables without one and ``Total`` for all groups together; ``running`` is the cumulative percent in code order of
    the tables that ask for it.
    """
    ages = [age_group(a) for a in dict.fromkeys(a for t in tables for a in t.ages)]

    def where(condition) -> Column:
        return F.col("table").isin(*[i for i, t in enumerate(tables) if condition(t)])

    # Cells only from here on; their number depends on code lists.
    cells = base_cells(prepared, tables, weights)
    cells = cells.withColumn("Age_group", F.explode(age_memberships(ages, "__ages")))
    cells = cells.withColumn("Sector", F.explode(sector_memberships(where(lambda t: t.pooled))))
    cells = cells.withColumn("Gender", F.explode(F.array("Gender", F.lit(PERSONS))))
    groups = F.when(where(lambda t: t.group and t.total), F.array("group", F.lit(ALL_GROUPS))).otherwise(F.array("group"))
    cells = cells.withColumn("group", F.explode(groups))
    slices = ["table", "Age_group", "Sector", "Gender", "group"]
    sums = cells.groupBy(*slices, "code").agg(F.sum("n").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(weights))])
    sides = [F.struct(F.lit(name).alias("weighting"), F.col(f"w{i}").alias("weighted")) for i, name in enumerate(weights)]
    sums = sums.select(*slices, "code", "n", F.inline(F.array(*sides)))
    window = Window.partitionBy(*slices, "weighting")
    upto = window.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("weighted").over(window)
    shares = sums.withColumns({
        "percent": F.try_divide(100 * F.col("weighted"), total),
        "running": F.when(where(lambda t: t.running), F.try_divide(100 * F.sum("weighted").over(upto), total))})
    chosen = F.lit(True)
    for number, t in enumerate(tables):
        if t.only:
            chosen = chosen & ((F.col("table") != number) | (F.col("code") == t.only))
    names = F.array(*[F.lit(t.name) for t in tables])
    return shares.filter(chosen).select(
        F.element_at(names, F.col("table") + 1).alias("table"), *slices[1:], "code", "weighting", "n", "percent", "running")


def spending_means(prepared: DataFrame, weight: str = "Weight") -> DataFrame:
    """Mean household spending of persons with its standard error, by sector and gender, each also pooled; the sum of weights
    counts as the number of observations."""
    rows = prepared.select("Household_monthly_spending", weight, F.explode(sector_memberships()).alias("Sector"), "Gender")
    rows = rows.withColumn("Gender", F.explode(F.array("Gender", F.lit(PERSONS))))
    return tb.weighted_summary(rows, "Household_monthly_spending", weight, ["Sector", "Gender"], weight_kind="iweight")
