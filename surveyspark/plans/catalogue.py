"""The report catalogue, computed in one pass over the prepared rows.

Every row feeds many tables.  The tasks that hold the rows count them by (table, group, code), some at a time, and one small
aggregation adds up those cells, whose number depends on code lists only.  The cells are
written once and everything else works on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import weights
from surveyspark.functions.recode import label_table
from surveyspark.operators import cells as cl
from surveyspark.operators import tabulate as tb
from surveyspark.operators.populations import age_bits, age_group, population, sector_memberships
from surveyspark.runtime import materialise, small_table

RATES, SHARES, MEANS = "rates", "shares", "means"


@dataclass(frozen=True)
class TableSpec:
    """One sheet: what is tabulated, for whom, at which ages."""

    sheet: str
    kind: str
    column: str | None
    population: str
    ages: tuple[str, ...]
    group: str | None = None
    combined: bool = True


def _shares(sheet, column, who, ages, group=None, combined=True):
    return TableSpec(sheet, SHARES, column, who, tuple(ages), group, combined)


_ALL_15 = ("All ages", "15+")

# The 31 sheets, their populations and their ages.
CATALOGUE: tuple[TableSpec, ...] = (
    TableSpec("rates", RATES, None, "All persons", ("All ages", "15+", "15-29")),
    TableSpec("rates_social_group", RATES, None, "All persons", _ALL_15, "Social_group"),
    TableSpec("rates_state_youth", RATES, None, "All persons", ("15-29",), "State_code"),
    _shares("employment_status", "Broad_status", "Workers", _ALL_15),
    _shares("employment_social_group", "Broad_status", "Workers", _ALL_15, "Social_group"),
    _shares("employment_religion", "Broad_status", "Workers", _ALL_15, "Religion"),
    _shares("employment_NIC_broad", "Broad_status", "Workers", _ALL_15, "NIC_broad"),
    _shares("employment_NIC_three", "Broad_status", "Workers", _ALL_15, "NIC_three"),
    _shares("NIC_division", "NIC_division", "Workers", _ALL_15),
    _shares("NIC_broad", "NIC_broad", "Workers", _ALL_15),
    _shares("NIC_three", "NIC_three", "Workers", _ALL_15),
    _shares("NCO_group", "NCO", "Workers", _ALL_15),
    _shares("NCO_subdivision", "NCO_subdivision", "Workers", _ALL_15),
    _shares("NCO_division", "NCO_division", "Workers", _ALL_15),
    _shares("vocational_labour_force", "Training_code", "Labour force", ("15-59",)),
    _shares("vocational_15_59", "Training_code", "All persons", ("15-59",)),
    _shares("social_security", "Social_security", "Employees", ("15+",)),
    _shares("household_type", "Household_type", "Labour force", ("15+",), combined=False),
    _shares("religion", "Religion", "Labour force", ("15+",)),
    _shares("social_group", "Social_group", "Labour force", ("15+",)),
    _shares("household_spending", "Household_spending_band", "Labour force", ("15+",)),
    _shares("marital_status", "Marital_status", "Labour force", ("15+",)),
    _shares("attendance", "Attendance_group", "Labour force", ("15-29",)),
    _shares("training_field", "Training_field", "Formal trainees in labour force", ("15-59",)),
    _shares("training_duration", "Training_duration", "Formal trainees in labour force", ("15-59",)),
    _shares("training_type", "Training_type", "Formal trainees in labour force", ("15-59",)),
    _shares("economic_months", "Economic_months", "Workers", ("15+",)),
    _shares("efforts_to_find_work", "Efforts_to_find_work", "Principal unemployed", ("15+",)),
    _shares("unemployment_duration", "Unemployment_duration", "Unemployed", ("15+",)),
    _shares("reason_not_working", "Reason_not_working", "Non-workers", ("15+",)),
    TableSpec("mean_HH_spending", MEANS, None, "All persons", ("All ages",)),
)

_STATES = ("work", "seek", "out")


def _measure(spec: TableSpec) -> str:
    """What a sheet shows, put together from its specification."""
    if spec.kind == RATES:
        what = "rates LFPR, WPR, UR"
    else:
        what = f"{'mean' if spec.kind == MEANS else 'percent'} of {spec.column}"
    by = f" by {spec.group}" if spec.group else ""
    return f"{what}{by}; sectors {', '.join([*cb.SECTORS, *([cb.POOLED_SECTOR] if spec.combined else [])])}; weighted"


def guide(spark: SparkSession, specs: Sequence[TableSpec] = CATALOGUE) -> DataFrame:
    """One row for each sheet, derived from its specification."""
    rows = [(s.sheet, s.population, "; ".join(s.ages), _measure(s)) for s in specs]
    return small_table(spark, rows, "Sheet string, Population string, Ages string, Meaning string")


def notes(spark: SparkSession, mode: str, specs: Sequence[TableSpec] = CATALOGUE) -> DataFrame:
    """The definitions that were used: weight, populations, age groups and bands, written out from the code that applies them."""
    def text(column: Column) -> str:
        return column._jc.toString()

    weight = weights.historical_weight() if mode == "video" else weights.annual_weight()
    rows = [("mode", mode, mode), ("weight", "Weight", text(weight))]
    rows += [("population", name, text(population(name))) for name in dict.fromkeys(s.population for s in specs)]
    ages = [age_group(name) for name in dict.fromkeys(a for s in specs for a in s.ages)]
    rows += [("age group", g.name, f"{g.lower} to {g.upper}" if g.upper is not None else f"{g.lower} and over") for g in ages]
    for column, bands in (("NIC_broad", cb.NIC_BROAD_BANDS), ("NIC_three", cb.NIC_THREE_BANDS), ("Attendance_group", cb.ATTENDANCE_BANDS)):
        rows += [("band", f"{column} {b.code}", f"{b.lower} to {b.upper}") for b in bands]
    return small_table(spark, rows, "Topic string, Name string, Definition string")


def _code(spec: TableSpec) -> Column:
    if spec.kind == RATES:
        return F.when(F.col("Worker"), _STATES[0]).when(F.col("Unemployed"), _STATES[1]).otherwise(_STATES[2])
    if spec.kind == MEANS:
        return F.when(F.col("Household_monthly_spending").isNotNull(), "known").otherwise("blank")
    return F.col(spec.column).cast("string")


def _code_name(spec: TableSpec) -> str:
    return spec.column or f"({spec.kind})"


def fine_cells(prepared: DataFrame, specs: Sequence[TableSpec] = CATALOGUE, weight: str = "Weight") -> DataFrame:
    """Sample counts, weights and weighted spending by (spec, ages, sector, gender, group, code)."""
    if len({s.sheet for s in specs}) != len(specs):
        raise ValueError("sheet names must be unique: cells of equal names would be pooled")
    ages = _ages(specs)
    bits = {a.name: 1 << i for i, a in enumerate(ages)}
    tables = [cl.Table(s.population, _code_name(s), s.group, sum(bits[a] for a in s.ages)) for s in specs]
    codes = {_code_name(s): _code(s) for s in specs} | {s.group: F.col(s.group) for s in specs if s.group}
    cells = cl.cell_sums(
        prepared, tables, {s.population: population(s.population) for s in specs}, codes, age_bits(ages),
        {"w": F.col(weight), "wx": F.col(weight) * F.col("Household_monthly_spending")})
    return cells.select(
        F.col("table").alias("__spec"), F.col("ages").alias("__ages"), "Sector_code", "Gender",
        F.coalesce("group", F.lit("")).alias("__group"), F.col("code").alias("__code"), "n", "w", "wx")


def _ages(specs: Sequence[TableSpec]) -> list[cb.AgeGroup]:
    used = {a for s in specs for a in s.ages}
    unknown = used - set(cb.AGE_GROUPS)
    if unknown:
        raise ValueError(f"unknown age groups: {sorted(unknown)}")
    return [age_group(a) for a in cb.AGE_GROUPS if a in used]


def _spec_table(spark: SparkSession, specs: Sequence[TableSpec]) -> DataFrame:
    """One row per sheet and age group, with the bit that marks membership."""
    bits = {a.name: 1 << i for i, a in enumerate(_ages(specs))}
    rows = [(i, s.sheet, s.kind, s.combined, s.group, s.column, age, bits[age])
            for i, s in enumerate(specs) for age in s.ages]
    return small_table(
        spark, rows, "__spec int, sheet string, kind string, combined boolean, group_domain string, domain string, "
              "Age_group string, __bit int")


def heading_cells(cells: DataFrame, specs: Sequence[TableSpec] = CATALOGUE) -> DataFrame:
    """Fine cells under every sheet heading they belong to."""
    dims = _spec_table(cells.sparkSession, specs)
    out = cells.join(dims, "__spec").filter(F.col("__ages").bitwiseAND(F.col("__bit")) > 0)
    return out.withColumn("Sector", F.explode(sector_memberships(F.col("combined")))).select(
        "sheet", "kind", "domain", "group_domain", "Age_group", "Sector",
        F.col("__group").alias("group_code"), F.col("__code").alias("code"), "Gender", "n", "w", "wx")


_HEADS = ("sheet", "domain", "group_domain", "Age_group", "Sector", "group_code")


def report_cells(prepared: DataFrame, specs: Sequence[TableSpec] = CATALOGUE, weight: str = "Weight") -> DataFrame:
    """All sheets in one tidy table.

    ``(sheet, Age_group, Sector, group_code, group_label, code, label, gender, measure, value)``; measures are
    ``share``, or ``n``, ``weighted``, ``LFPR``, ``WPR``, ``UR``, ``mean``.
    """
    cells = materialise(fine_cells(prepared, specs, weight))
    headed = heading_cells(cells, specs)
    kinds = {s.kind for s in specs}
    parts = []
    if SHARES in kinds:
        parts.append(_share_part(headed.filter(F.col("kind") == SHARES), specs))
    if RATES in kinds:
        parts.append(_rate_part(headed.filter(F.col("kind") == RATES)))
    if MEANS in kinds:
        parts.append(_mean_part(headed.filter(F.col("kind") == MEANS)))
    tidy = parts[0]
    for part in parts[1:]:
        tidy = tidy.unionByName(part)
    return _with_labels(tidy)


def _share_part(headed: DataFrame, specs: Sequence[TableSpec]) -> DataFrame:
    pieces = headed.withColumns({
        "Male": F.when(F.col("Gender") == "Male", F.col("w")).otherwise(F.lit(0.0)),
        "Female": F.when(F.col("Gender") == "Female", F.col("w")).otherwise(F.lit(0.0)),
    })
    status = tb.code_memberships(F.col("code"), ["Male", "Female"], tb.STATUS_CATEGORIES, tb.STATUS_SUBTOTALS)
    plain = tb.code_memberships(F.col("code"), ["Male", "Female"], None, {})
    memberships = F.when(F.col("domain") == "Broad_status", status).otherwise(plain)
    counts = pieces.select(*_HEADS, F.inline(memberships)).groupBy(*_HEADS, "Code").agg(
        F.sum("Male").alias("Male"), F.sum("Female").alias("Female"))
    shares = tb.shares_from_counts(counts, _HEADS)
    return shares.select(*_HEADS, F.col("Code").alias("code"), F.inline(F.array(*[
        F.struct(F.lit(g).alias("gender"), F.lit("share").alias("measure"), F.col(g).alias("value"))
        for g in cb.GENDERS])))


def _rate_part(headed: DataFrame) -> DataFrame:
    sums = []
    for g in cb.GENDERS:
        mine = F.lit(True) if g == "Persons" else F.col("Gender") == g
        sums.append(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"n_{g}"))
        for state in _STATES:
            sums.append(F.coalesce(F.sum(F.when(mine & (F.col("code") == state), F.col("w"))), F.lit(0.0))
                        .alias(f"{state}_{g}"))
    wide = headed.groupBy(*_HEADS).agg(*sums)
    rows = []
    for g in cb.GENDERS:
        work, seek, out = (F.col(f"{s}_{g}") for s in _STATES)
        for measure, value in (
            ("n", F.col(f"n_{g}").cast("double")), ("weighted", work + seek + out),
            ("LFPR", F.try_divide(100 * (work + seek), work + seek + out)),
            ("WPR", F.try_divide(100 * work, work + seek + out)), ("UR", F.try_divide(100 * seek, work + seek)),
        ):
            rows.append(F.struct(F.lit(g).alias("gender"), F.lit(measure).alias("measure"), value.alias("value")))
    return wide.select(*_HEADS, F.lit(None).cast("string").alias("code"), F.inline(F.array(*rows)))


def _mean_part(headed: DataFrame) -> DataFrame:
    known = F.col("code") == "known"
    sums = []
    for g in cb.GENDERS:
        mine = known if g == "Persons" else known & (F.col("Gender") == g)
        for name in ("n", "w", "wx"):
            sums.append(F.coalesce(F.sum(F.when(mine, F.col(name))), F.lit(0)).alias(f"{name}_{g}"))
    wide = headed.groupBy(*_HEADS).agg(*sums)
    rows = []
    for g in cb.GENDERS:
        for measure, value in (("n", F.col(f"n_{g}").cast("double")), ("mean", F.try_divide(f"wx_{g}", f"w_{g}"))):
            rows.append(F.struct(F.lit(g).alias("gender"), F.lit(measure).alias("measure"), value.alias("value")))
    return wide.select(*_HEADS, F.lit(None).cast("string").alias("code"), F.inline(F.array(*rows)))


def _with_labels(tidy: DataFrame) -> DataFrame:
    labels = label_table(tidy.sparkSession)
    groups = labels.select(F.col("domain").alias("group_domain"), F.col("code").alias("group_code"),
                           F.col("label").alias("__group"))
    codes = labels.withColumnRenamed("label", "__label")
    out = tidy.join(groups, ["group_domain", "group_code"], "left").join(codes, ["domain", "code"], "left")
    grouped = F.col("group_domain").isNotNull()
    return out.select(
        "sheet", "Age_group", "Sector",
        F.when(grouped, F.col("group_code")).alias("group_code"),
        F.when(grouped, F.coalesce("__group", "group_code")).alias("group_label"),
        "code",
        F.when(F.col("code") == cb.TOTAL_CODE, cb.TOTAL_LABEL).otherwise(F.coalesce("__label", "code")).alias("label"),
        "gender", "measure", "value")


def sheet(cells: DataFrame, name: str, specs: Sequence[TableSpec] = CATALOGUE) -> DataFrame:
    """One sheet in its printed shape."""
    spec = next(s for s in specs if s.sheet == name)
    rows = cells.filter(F.col("sheet") == name)
    heads = ["Age_group", "Sector", *(["group_code", "group_label"] if spec.group else [])]
    if spec.kind == SHARES:
        wide = rows.groupBy(*heads, "code", "label").agg(
            *[F.max(F.when(F.col("gender") == g, F.col("value"))).alias(g) for g in cb.GENDERS])
        names = {"code": "Code", "label": spec.column if spec.column != spec.group else f"{spec.column}_category"}
    else:
        measures = {"n": "Sample_persons"} | (
            {"weighted": "Weighted_persons", "LFPR": "LFPR", "WPR": "WPR", "UR": "UR"} if spec.kind == RATES
            else {"mean": "Mean_rupees"})
        wide = rows.groupBy(*heads, "gender").agg(
            *[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(n) for m, n in measures.items()])
        names = {"gender": "Gender"}
    if spec.group:
        wide = wide.withColumnRenamed("group_label", spec.group).drop("group_code")
    return wide.withColumnsRenamed(names)


def headline(cells: DataFrame) -> DataFrame:
    """The three rates for all persons aged 15 and over in both sectors."""
    rows = sheet(cells, "rates")
    return rows.filter((F.col("Age_group") == "15+") & (F.col("Sector") == cb.POOLED_SECTOR)
                       & (F.col("Gender") == "Persons")).select("LFPR", "WPR", "UR")
