"""Weighted rates, shares, means, cross-tabs and summaries.

Each table aggregates once on the raw rows, at the finest grain its headings need; partial
aggregation makes a hot group no heavier than any other.  Headings, subtotals, totals and percents
are then made from those cells, whose number depends on the code lists and not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark import codebook as cb
from surveyspark.functions.recode import with_label
from surveyspark.operators.populations import age_bits, age_group, population, spread

STATUS_CATEGORIES = ("1", "2", "3", "4")
STATUS_SUBTOTALS = {"self": ("1", "2")}


def _by_gender(measure: str, gender: str) -> Column:
    value = F.col(measure) if gender == "Persons" else F.when(F.col("Gender") == gender, F.col(measure))
    return F.coalesce(F.sum(value), F.lit(0))


def _members(df: DataFrame, population_name: str, group: str | None) -> DataFrame:
    rows = df.filter(population(population_name)) if population_name != "All persons" else df
    return rows.filter(F.col(group).isNotNull()) if group else rows


def weighted_rates(df: DataFrame, ages: Sequence[str], group: str | None = None,
                   weight: str = "Weight") -> DataFrame:
    """Participation, worker and unemployment rates by age x sector (x group) x gender.

    A heading with anybody in it has all three genders, an empty one with zero counts and NULL rates.
    """
    groups = [age_group(a) for a in ages]
    rows = _members(df, "All persons", group)
    w = F.col(weight)
    extra = [group] if group else []
    cells = rows.groupBy(age_bits(groups).alias("__ages"), "Sector_code", "Gender", *extra).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("all"),
        F.sum(F.when(F.col("Labour_force"), w)).alias("labour"),
        F.sum(F.when(F.col("Worker"), w)).alias("work"),
        F.sum(F.when(F.col("Unemployed"), w)).alias("seek"),
    )
    heads = ["Age_group", "Sector", *extra]
    measures = ("n", "all", "labour", "work", "seek")
    wide = spread(cells, groups).groupBy(*heads).agg(
        *[_by_gender(m, g).alias(f"{m}_{g}") for g in cb.GENDERS for m in measures])
    table = wide.select(*heads, F.inline(F.array(*[_rate_row(g) for g in cb.GENDERS])))
    return _label_group(table, group)


def _rate_row(g: str) -> Column:
    n, everyone, labour, work, seek = (F.col(f"{m}_{g}") for m in ("n", "all", "labour", "work", "seek"))
    return F.struct(
        F.lit(g).alias("Gender"),
        n.alias("Sample_persons"),
        everyone.cast("double").alias("Weighted_persons"),
        F.try_divide(100 * labour, everyone).alias("LFPR"),
        F.try_divide(100 * work, everyone).alias("WPR"),
        F.try_divide(100 * seek, labour).alias("UR"),
    )


def _label_group(table: DataFrame, group: str | None) -> DataFrame:
    """Show the heading group by label; an unlabelled code shows as itself."""
    return table if group is None else with_label(table, group, group, group)


def code_memberships(code: Column, measures: Sequence[str], categories: Sequence[str] | None,
                     subtotals: Mapping[str, Sequence[str]]) -> Column:
    """The output rows a cell feeds: its category, its subtotals and the total.

    With a fixed category list every category gets a row, zero where the cell is in another one.
    """
    def entry(name, factor=None):
        values = [(F.col(m) if factor is None else F.when(factor, F.col(m)).otherwise(F.lit(0))).cast("double").alias(m)
                  for m in measures]
        return F.struct(name.alias("Code"), *values)

    if categories is None:
        rows = [entry(code)]
    else:
        rows = [entry(F.lit(c), code == c) for c in categories]
    rows += [entry(F.lit(name), code.isin(*parts)) for name, parts in subtotals.items()]
    rows.append(entry(F.lit(cb.TOTAL_CODE)))
    return F.array(*rows)


def weighted_shares(df: DataFrame, column: str, ages: Sequence[str], population_name: str = "Workers",
                    group: str | None = None, combined: bool = True, weight: str = "Weight",
                    categories: Sequence[str] | None = None,
                    subtotals: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Share of each category among the reported answers of a heading, per gender.

    Blank answers are left out.  ``Persons`` pools the weights of both genders.  The employment-type
    column always shows its four categories, the self-employed subtotal and the total.
    """
    if column == "Broad_status" and categories is None and subtotals is None:
        categories, subtotals = STATUS_CATEGORIES, STATUS_SUBTOTALS
    groups = [age_group(a) for a in ages]
    rows = _members(df, population_name, group).filter(F.col(column).isNotNull())
    extra = {"__group": F.col(group)} if group else {}
    cells = rows.groupBy(
        age_bits(groups).alias("__ages"), "Sector_code", "Gender",
        *[c.alias(n) for n, c in extra.items()], F.col(column).cast("string").alias("__code"),
    ).agg(F.sum(weight).alias("w"))
    heads = ["Age_group", "Sector", *extra]
    pieces = cells.select("__ages", "Sector_code", *extra, "__code",
                          F.when(F.col("Gender") == "Male", F.col("w")).otherwise(F.lit(0.0)).alias("Male"),
                          F.when(F.col("Gender") == "Female", F.col("w")).otherwise(F.lit(0.0)).alias("Female"))
    spelled = spread(pieces, groups, combined).select(
        *heads, F.inline(code_memberships(F.col("__code"), ["Male", "Female"], categories, subtotals or {})))
    counts = spelled.groupBy(*heads, "Code").agg(F.sum("Male").alias("Male"), F.sum("Female").alias("Female"))
    table = shares_from_counts(counts, heads)
    if group:
        table = table.withColumnRenamed("__group", group)
        table = _label_group(table, group)
    labels = {column: {**cb.LABELS.get(column, {}), cb.TOTAL_CODE: cb.TOTAL_LABEL}}
    # The shown category gets its own name when the heading already uses it.
    name = column if column != group else f"{column}_category"
    table = with_label(table, "Code", column, name, labels)
    return table.select("Age_group", "Sector", *([group] if group else []), "Code", name, *cb.GENDERS)


def shares_from_counts(counts: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Percent of the heading's total row; NULL for a gender without any weight.

    The window runs over finished cells: one row per category of a heading.
    """
    heading = Window.partitionBy(*heads)
    counts = counts.withColumn("Persons", F.col("Male") + F.col("Female"))
    totals = {f"__{g}": F.max(F.when(F.col("Code") == cb.TOTAL_CODE, F.col(g))).over(heading) for g in cb.GENDERS}
    counts = counts.withColumns(totals)
    shares = {
        g: F.when(F.col("Code") == cb.TOTAL_CODE, F.when(F.col(f"__{g}") != 0, F.lit(100.0)))
        .otherwise(F.try_divide(100 * F.col(g), F.col(f"__{g}")))
        for g in cb.GENDERS
    }
    return counts.withColumns(shares).drop(*totals)


def share_totals(table: DataFrame, heads: Sequence[str], subtotals: Sequence[str] = ("self",)) -> DataFrame:
    """Largest distance from 100 of the summed shares, per gender column."""
    parts = table.filter(~F.col("Code").isin(cb.TOTAL_CODE, *subtotals))
    sums = parts.groupBy(*heads).agg(*[F.sum(g).alias(g) for g in cb.GENDERS])
    worst = sums.agg(*[F.max(F.abs(F.col(g) - 100)).alias(g) for g in cb.GENDERS])
    return worst.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("Gender"), F.col(g).alias("max_gap")) for g in cb.GENDERS])))


def share_check(table: DataFrame, heads: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """:func:`share_totals` as a check report."""
    return share_totals(table, heads).select(
        F.concat(F.lit("shares total 100: "), "Gender").alias("check"),
        F.when(F.coalesce(F.col("max_gap"), F.lit(0.0)) > tolerance, 1).otherwise(0).cast("long").alias("violations"))


def weighted_means(df: DataFrame, value: str, ages: Sequence[str] = ("All ages",), weight: str = "Weight",
                   name: str = "Mean_rupees") -> DataFrame:
    """Weighted mean over reported values by age x sector x gender, with the sample count.

    A heading exists if anybody is in it, also where nobody reported the value.
    """
    groups = [age_group(a) for a in ages]
    known, w = F.col(value).isNotNull(), F.col(weight)
    cells = df.groupBy(age_bits(groups).alias("__ages"), "Sector_code", "Gender").agg(
        F.count_if(known).alias("n"),
        F.sum(F.when(known, w)).alias("w"),
        F.sum(w * F.col(value)).alias("wx"),
    )
    heads = ["Age_group", "Sector"]
    wide = spread(cells, groups).groupBy(*heads).agg(
        *[_by_gender(m, g).alias(f"{m}_{g}") for g in cb.GENDERS for m in ("n", "w", "wx")])
    return wide.select(*heads, F.inline(F.array(*[
        F.struct(F.lit(g).alias("Gender"), F.col(f"n_{g}").alias("Sample_persons"),
                 F.try_divide(F.col(f"wx_{g}"), F.col(f"w_{g}")).alias(name))
        for g in cb.GENDERS])))


# --- margins and cross-tabs ----------------------------------------------------------------------

TOTAL = "Total"


def mean_margins(df: DataFrame, dims: Sequence[str], value: str, weight: str = "Weight",
                 margins: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Weighted mean of ``value`` for all combinations of ``dims`` and their margins.

    ``margins`` lists the dimension subsets to show (default: all of them, as a cube).  Margins pool
    weights.  Rows with a missing dimension are not part of the table.
    """
    rows = df
    for dim in dims:
        rows = rows.filter(F.col(dim).isNotNull())
    known, w = F.col(value).isNotNull(), F.col(weight)
    cells = rows.groupBy(*[F.col(d).cast("string").alias(d) for d in dims]).agg(
        F.count_if(known).alias("n"), F.sum(F.when(known, w)).alias("w"), F.sum(w * F.col(value)).alias("wx"))
    pooled = _grouping_sets(cells, dims, margins).agg(
        F.sum("n").alias("n"), F.sum("w").alias("weighted"), F.sum("wx").alias("wx"))
    return pooled.select(
        *[F.coalesce(F.col(d), F.lit(TOTAL)).alias(d) for d in dims], "n",
        F.coalesce("weighted", F.lit(0.0)).alias("weighted"), F.try_divide("wx", "weighted").alias("mean"))


def _grouping_sets(cells: DataFrame, dims: Sequence[str], margins: Sequence[Sequence[str]] | None):
    columns = [F.col(d) for d in dims]
    if margins is None:
        return cells.cube(*columns)
    return cells.groupingSets([[F.col(d) for d in subset] for subset in margins], *columns)


def crosstab(df: DataFrame, row: str, column: str, percent: str = "row", weight: str | None = "Weight",
             by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Two-way table with margins: rows, weighted count and percent of the chosen margin.

    ``percent`` is ``row``, ``column`` or ``cell``.  ``by`` repeats the whole table.  Missing answers
    are left out; :func:`crosstab_counts` keeps them.
    """
    if percent not in {"row", "column", "cell"}:
        raise ValueError(f"percent must be row, column or cell, not {percent}")
    rows = df if where is None else df.filter(where)
    rows = rows.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    w = F.lit(1.0) if weight is None else F.col(weight)
    cells = rows.groupBy(*by, F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))
    sets = [[*by, row, column], [*by, row], [*by, column], [*by]]
    pooled = _grouping_sets(cells, [*by, row, column], sets).agg(F.sum("n").alias("n"), F.sum("w").alias("weighted"))
    pooled = pooled.withColumns({c: F.coalesce(F.col(c), F.lit(TOTAL)) for c in (row, column)})
    margin = {"row": (Window.partitionBy(*by, row), F.col(column) == TOTAL),
              "column": (Window.partitionBy(*by, column), F.col(row) == TOTAL),
              "cell": (Window.partitionBy(*by, F.lit(0)), (F.col(row) == TOTAL) & (F.col(column) == TOTAL))}[percent]
    base = F.max(F.when(margin[1], F.col("weighted"))).over(margin[0])
    return pooled.withColumn("percent", F.try_divide(100 * F.col("weighted"), base))


def crosstab_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Unweighted counts in which a missing answer is a level of its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def oneway(df: DataFrame, column: str, weight: str | None = "Weight", by: Sequence[str] = (),
           where: Column | None = None) -> DataFrame:
    """Weighted frequency, percent and running percent of one column, in code order."""
    rows = df if where is None else df.filter(where)
    rows = rows.filter(F.col(column).isNotNull())
    w = F.lit(1.0) if weight is None else F.col(weight)
    cells = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weighted"))
    # One row per code from here on.
    table = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = table.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("weighted").over(table)
    return cells.select(
        *by, column, "n", "weighted",
        F.try_divide(100 * F.col("weighted"), total).alias("percent"),
        F.try_divide(100 * F.sum("weighted").over(running), total).alias("cumulative"))


# --- summaries -----------------------------------------------------------------------------------

def weighted_summary(df: DataFrame, value: str, weight: str | None = "Weight", by: Sequence[str] = (),
                     where: Column | None = None, weight_kind: str = "iweight") -> DataFrame:
    """Rows, sum of weights, mean, standard deviation, standard error, minimum and maximum.

    ``iweight`` takes the sum of weights as the number of observations; ``aweight`` rescales weights
    to the number of rows.  Neither is a survey-design standard error.  Tasks keep one mergeable state for each group, with squares
    around its mean, and only states are shuffled: one pass, and a mean far larger than the spread costs no digits.
    Groups are compared null-safely; without rows there is no summary.
    """
    if weight_kind not in {"iweight", "aweight"}:
        raise ValueError(f"unknown weight kind: {weight_kind}")
    rows = df if where is None else df.filter(where)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    keys = [f"k{i}" for i in range(len(by))]
    rows = rows.filter(F.col(value).isNotNull() & w.isNotNull()).select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)], w.alias("w"), F.col(value).cast("double").alias("x"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[:-2])
    states = rows.mapInArrow(_states, kinds + ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in STATE))
    states = states.select(F.struct(F.lit(0).alias("all"), *keys).alias("group"), *STATE)
    centre = F.try_divide(F.sum(F.col("sum_w") * F.col("mean")).over(Window.partitionBy("group")), F.sum("sum_w").over(Window.partitionBy("group")))
    d = F.col("mean") - F.col("centre")
    sums = states.withColumn("centre", centre).groupBy("group").agg(
        F.sum("n").alias("n"), F.sum("sum_w").alias("sum_w"), F.first("centre").alias("centre"),
        F.sum(F.col("sum_w") * d).alias("s1"), F.sum(F.col("squares") + F.col("sum_w") * d * d).alias("s2"),
        F.min("min").alias("min"), F.max("max").alias("max"))
    observations = F.col("sum_w") if weight_kind == "iweight" else F.col("n").cast("double")
    offset = F.try_divide("s1", "sum_w")
    spread_ = F.try_divide("s2", "sum_w") - offset * offset
    return (
        sums.withColumn("mean", F.col("centre") + offset)
        .withColumn("sd", F.when(F.col("sum_w") > 0, F.sqrt(F.greatest(spread_, F.lit(0.0)) * F.try_divide(observations, observations - 1))))
        .withColumn("std_error", F.try_divide(F.col("sd"), F.sqrt(observations)))
        .select(*[F.col("group")[k].alias(b) for b, k in zip(by, keys)],
                "n", "sum_w", "mean", "sd", "std_error", "min", "max"))


STATE = ("n", "sum_w", "mean", "squares", "min", "max")
# Groups that a task keeps states of before it hands them on.
HELD_GROUPS = 50_000


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mergeable states by group: rows, weight, mean, weighted squares around it, ends."""
    held: dict[tuple, list] = {}
    keys: pa.Schema | None = None

    def flush() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(keys)]
        columns += [pa.array([v[i] for v in held.values()], pa.int64() if i == 0 else pa.float64()) for i in range(len(STATE))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=[*keys.names, *STATE])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pa.schema(list(batch.schema)[:-2])
        code = np.zeros(batch.num_rows, np.int64)
        for i in range(len(keys)):
            encoded = pc.dictionary_encode(batch.column(i), null_encoding="encode")
            code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(), return_inverse=True)[1]
        size = int(code.max()) + 1
        w, x = (batch.column(len(keys) + i).to_numpy() for i in range(2))
        n, weight = np.bincount(code, minlength=size), np.bincount(code, w, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Around the first value of a group, so that sums lose no digits.
            first = np.zeros(size)
            first[code[::-1]] = x[::-1]
            mean = first + np.where(weight != 0, np.bincount(code, w * (x - first[code]), size) / weight, 0.0)
        squares = np.bincount(code, w * (x - mean[code]) ** 2, size)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(low, code, x)
        np.maximum.at(high, code, x)
        one = np.zeros(size, np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]
        names = zip(*[batch.column(i).take(pa.array(one)).to_pylist() for i in range(len(keys))]) if keys.names else [()]
        for name, *new in zip(names, n.tolist(), weight.tolist(), mean.tolist(), squares.tolist(), low.tolist(), high.tolist()):
            old = held.get(name)
            if old is None:
                held[name] = new
                continue
            total, gap = old[1] + new[1], new[2] - old[2]
            share = new[1] / total if total else 0.0
            held[name] = [old[0] + new[0], total, old[2] + gap * share, old[3] + new[3] + gap * gap * old[1] * share,
                          min(old[4], new[4]), max(old[5], new[5])]
        if len(held) >= HELD_GROUPS:
            yield flush()
    if held:
        yield flush()


def mean_interval(summary: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Normal interval around the means of :func:`weighted_summary`."""
    return summary.withColumns({"ci_low": F.col("mean") - z * F.col("std_error"),
                                "ci_high": F.col("mean") + z * F.col("std_error")})


def counts(df: DataFrame, conditions: Mapping[str, Column], weight: str | None = None) -> DataFrame:
    """Sample count, and estimated population if weighted, of several conditions in one pass."""
    parts = []
    for name, condition in conditions.items():
        parts.append(F.count_if(F.coalesce(condition, F.lit(False))).alias(f"{name}_sample"))
        if weight is not None:
            parts.append(F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0.0)).alias(f"{name}_population"))
    return df.agg(*parts)


def levels(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Codes that occur in a subpopulation; an absent code is not a zero share."""
    rows = df if where is None else df.filter(where)
    return rows.filter(F.col(column).isNotNull()).select(column).distinct()
