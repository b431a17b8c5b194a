"""The wage models: regressions and gap decompositions over regular employees.

The models differ in dependent variable, weights and group comparison, but all of them are moment sums
over the same rows.  One pass therefore adds every row to one cell of a moment cube; blocks of models are rolled up
from its cells and solved from small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark import codebook as cb
from surveyspark.functions import recode, status
from surveyspark.operators import decompose as dc
from surveyspark.operators import ordered as od
from surveyspark.operators import regression as rg
from surveyspark.operators.gram import Design, Moments
from surveyspark.operators.quantreg import quantile_regression
from surveyspark.runtime import materialise_observed

PERCENTILES = (0.25, 0.75, 0.9)
RIFS = ("rif25", "rif75", "rif90")
WAGE = ("log_wage",)
TAUS = (0.10, 0.25, 0.50, 0.75, 0.90)
EDUCATION = tuple(cb.EDUCATION_DUMMIES)
CORE = ("Age", "age_sq", *EDUCATION, "dummy_urban", "dummy_married")
# The comparisons below use these social groups only; influence variables are made before that cut.
COMPARED_GROUPS = ("1", "2", "9")


@dataclass(frozen=True)
class Comparison:
    """Two groups (``group`` is 0 in the first and 1 in the second) and how their models are built.

    ``indicator`` says that a regression has a dummy for the first group; ``male`` that it has one for
    men.  Some regressions are weighted and some are not; decompositions always are.
    """

    name: str
    group: str
    indicator: bool
    male: bool
    wage_weights: tuple[bool, ...]
    rif_weighted: bool
    twofold: bool


COMPARISONS = (
    Comparison("gender", "dummy_female", False, True, (False, True), True, True),
    Comparison("scst_vs_others", "dummy_scst", True, True, (False,), False, True),
    Comparison("scst_women_vs_general_men", "dummy_fscst", True, False, (False,), False, False),
    Comparison("scst_women_vs_general_women", "dummy_fe_scst", True, False, (False,), False, False),
)


def group_dummies() -> dict[str, Column]:
    """Pairs of groups: (1, 2) codes and the two-sided dummies made from them."""
    social, gender = F.col("Social_group"), F.col("Gender_code")
    general_male = F.coalesce((social == "9") & (gender == "1"), F.lit(False))
    general_female = F.coalesce((social == "9") & (gender == "2"), F.lit(False))
    scst_female = F.coalesce(social.isin("1", "2") & (gender == "2"), F.lit(False))
    compare = recode.comparison_group(general_male, scst_female)
    females = recode.comparison_group(general_female, scst_female)
    return {
        "group_compare": compare, "female_gen_scst": females,
        "dummy_mg": recode.two_sided_dummy(compare, 1, 2), "dummy_fscst": recode.two_sided_dummy(compare, 2, 1),
        "dummy_fg": recode.two_sided_dummy(females, 1, 2), "dummy_fe_scst": recode.two_sided_dummy(females, 2, 1),
    }


def regular_employees(prepared: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Regular employees with the model columns, written once, and the means of these columns."""
    compared = F.col("Social_group").isin(*COMPARED_GROUPS)
    education = F.col("General_education").cast("int")
    rows = prepared.filter(status.cascaded_broad_status() == "3").withColumns({
        "log_wage": rg.log_wage("wage_regular_salaried"),
        "age_sq": F.col("Age") * F.col("Age"),
        "dummy_married": recode.two_sided_dummy("Marital_status", "2", "1"),
        "dummy_male": recode.two_sided_dummy("Gender_code", "1", "2"),
        "dummy_female": recode.two_sided_dummy("Gender_code", "2", "1"),
        "dummy_urban": recode.two_sided_dummy("Sector_code", "2", "1"),
        "dummy_scst": F.when(compared, (F.col("Social_group") != "9").cast("int")),
        **{name: recode.plain_dummy(education.isin(*codes)) for name, codes in cb.EDUCATION_DUMMIES.items()},
        **group_dummies(),
    })
    groups = [c.group for c in COMPARISONS]
    x = [*CORE, "dummy_male"]
    return materialise_observed(rows.select("log_wage", "Weight", "Social_group", *x, *groups),
                                {n: F.avg(F.col(n).cast("double")) for n in (*WAGE, *x)})


def _with_influence(prepared: DataFrame, rif_kind: str) -> tuple[DataFrame, Design]:
    """The model table with influence variables, and its design with the constants to subtract.

    Constants are means to nine digits, as later ones depend on the order of adding up.  The mean of an
    influence variable is near its quantile less 1 / (1 - p), or near the quantile itself.
    """
    table, means = regular_employees(prepared)
    x = [*CORE, "dummy_male"]
    with_rif, quantiles = od.add_rif(table, "log_wage", PERCENTILES, kind=rif_kind, cut_lineage=False)
    for name, (p, q) in zip(RIFS, sorted(quantiles.items())):
        means[name] = q - 1 / (1 - p) if rif_kind == "reference" else q
    shift = {n: float(f"{means.get(n) or 0.0:.9g}") for n in (*WAGE, *RIFS, *x)}
    return with_rif, Design((*WAGE, *RIFS), tuple(x), shift)


def model_table(prepared: DataFrame, rif_kind: str = "reference") -> DataFrame:
    """Regular employees with every model column, including the influence variables.

    Percentiles come from all regular employees with a wage, whatever their social group.
    """
    return _with_influence(prepared, rif_kind)[0]


def moment_cells(table: DataFrame, plan: Design) -> DataFrame:
    """``(cell, i, v)``: moment sums of each kind of row, as a cube that all models are rolled up from.

    The kind of a row tells its side in every comparison and which dependent variables it has.  Each row is added to one cell, once
    weighted and once not: entry 0 is the row count, then the upper triangle with weights, then without.
    """
    known = [F.when(F.col(c.group).isin(0, 1), F.col(c.group).cast("int")).otherwise(2) for c in COMPARISONS]
    known += [F.col(name).isNotNull().cast("int") for name in (WAGE[0], RIFS[0])]
    cell = F.lit(0)
    for digit in known:
        cell = cell * 3 + digit
    complete = F.lit(True)
    for column in plan.x:
        complete = complete & F.col(column).isNotNull()
    # A missing dependent variable adds nothing to the models that do not use it.
    rows = table.filter(complete).select(
        cell.alias("cell"), F.coalesce(F.col("Weight").cast("double"), F.lit(0.0)).alias("w"),
        *[F.coalesce(F.col(n).cast("double") - F.lit(plan.shift[n]), F.lit(0.0)).alias(n) for n in (*plan.x, *plan.y)])
    size = len(plan.names)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            z = np.column_stack([np.ones(batch.num_rows), *values[2:]])
            for kind in np.unique(values[0]).tolist():
                here = values[0] == kind
                part, w = z[here], values[1][here]
                each = np.concatenate([[len(w)], ((part * w[:, None]).T @ part)[upper], (part.T @ part)[upper]])
                sums[kind] = sums.get(kind, 0.0) + each
        for kind, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), kind), pa.int32()), pa.array(np.arange(len(total)), pa.int32()),
                                              pa.array(total)], names=["cell", "i", "v"])

    return rows.mapInArrow(run, "cell int, i int, v double").groupBy("cell", "i").agg(F.sum("v").alias("v"))


def block_moments(prepared: DataFrame, rif_kind: str = "reference") -> tuple[DataFrame, Design]:
    """Moment rows by comparison, variable set and weighting, both sides of the comparison next to each other.

    Rolled up from the cells; a cell enters a block if its rows have all of the block's columns.  Reference-kind influence variables
    exist for rows without a wage; the log wage does not.
    """
    table, plan = _with_influence(prepared, rif_kind)
    digits = len(COMPARISONS) + 2

    def digit(place: int) -> Column:
        return F.floor(F.col("cell") / 3 ** (digits - 1 - place)).cast("int") % 3

    length = len(plan.names) * (len(plan.names) + 1) // 2
    blocks = []
    for place, c in enumerate(COMPARISONS):
        for offset, name in enumerate(("wage", "rif")):
            for weighted in (False, True):
                first = 1 if weighted else 1 + length
                index = F.when(F.col("i") == 0, -1).otherwise(F.col("i") - first)
                inside = (digit(place) < 2) & (digit(len(COMPARISONS) + offset) == 1) & (index >= -1) & (index < length) & (
                    (F.col("i") == 0) | (F.col("i") >= first))
                blocks.append(F.when(inside, F.struct(
                    F.lit(c.name).alias("comparison"), F.lit(name).alias("variables"), F.lit(weighted).alias("weighted"),
                    digit(place).alias("side"), index.alias("index"))))
    keys = ["comparison", "variables", "weighted"]
    # From here on a few thousand numbers, whatever the row count.
    entries = moment_cells(table, plan).select("v", F.explode(F.array_compact(F.array(*blocks))).alias("block")).select("block.*", "v")
    sums = entries.groupBy(*keys, "side", "index").agg(F.sum("v").alias("v"))
    sides = sums.groupBy(*keys).agg(*[piece for g in (0, 1) for piece in (
        F.max(F.when((F.col("side") == g) & (F.col("index") < 0), F.col("v"))).cast("bigint").alias(f"n{g}"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("side") == g) & (F.col("index") >= 0), F.struct("index", "v")))),
                    lambda x: x["v"]).alias(f"moments{g}"))])
    return sides.filter("n0 IS NOT NULL AND n1 IS NOT NULL"), plan


def _with_indicator(first: Moments, second: Moments) -> Moments:
    """Both sides together, with a dummy that is 1 on the first side."""
    both = first + second
    place = 1 + len(both.plan.x)
    matrix = np.insert(np.insert(both.matrix, place, 0.0, axis=0), place, 0.0, axis=1)
    others = [i for i in range(len(matrix)) if i != place]
    matrix[place, others] = matrix[others, place] = first.matrix[0]
    matrix[place, place] = first.weight
    plan = Design(both.plan.y, (*both.plan.x, "indicator"), {**both.plan.shift, "indicator": 0.0})
    return Moments(plan, both.n, matrix)


def _solve_blocks(sides: DataFrame, plan: Design, schema: T.StructType, models) -> DataFrame:
    """Apply ``models(comparison, variables, weighted, first, second)`` to every block where it lies."""
    known = {c.name: c for c in COMPARISONS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                first = Moments.from_row(plan, row.n0, row.moments0)
                second = Moments.from_row(plan, row.n1, row.moments1)
                ys = WAGE if row.variables == "wage" else RIFS
                out += models(known[row.comparison], ys, bool(row.weighted), first, second)
            yield pd.DataFrame(out, columns=schema.names)

    return sides.mapInPandas(run, schema)


def _regressions(c: Comparison, ys, weighted, first, second) -> list[list]:
    wanted = c.wage_weights if ys == WAGE else (c.rif_weighted,)
    if weighted not in wanted:
        return []
    moments = _with_indicator(first, second)
    x = [*(["indicator"] if c.indicator else []), *CORE, *(["dummy_male"] if c.male else [])]
    out = []
    for y in ys:
        fit = rg.solve(moments, y, x, "iweight")
        errors = np.sqrt(np.maximum(np.diag(fit.cov), 0))
        for term, value, error, gone in zip(fit.terms, fit.beta, errors, fit.omitted):
            out.append([c.name, "weighted" if weighted else "unweighted", y, term, value, error,
                        value / error if error > 0 else None, gone, fit.n, fit.r2])
    return out


def _decompositions(c: Comparison, ys, weighted, first, second) -> list[list]:
    if not weighted:
        return []
    out = []
    for y in ys:
        out += [[c.name, "threefold", y, *r] for r in dc.threefold(first, second, y, list(CORE), "iweight", True)]
        if c.twofold and ys == WAGE:
            out += [[c.name, "twofold", y, *r] for r in dc.twofold(first, second, y, list(CORE), "iweight", False)]
    return out


def regressions(prepared: DataFrame, rif_kind: str = "reference") -> DataFrame:
    """All mean and influence-variable regressions; ``indicator`` is the dummy of the first group."""
    sides, plan = block_moments(prepared, rif_kind)
    schema = T.StructType([T.StructField("comparison", T.StringType()), T.StructField("weighting", T.StringType()),
                           *rg.COEFFICIENTS.fields])
    return _solve_blocks(sides, plan, schema, _regressions)


def decompositions(prepared: DataFrame, rif_kind: str = "reference") -> DataFrame:
    """All weighted gaps: threefold with details, and the pooled split of the first two wage gaps."""
    sides, plan = block_moments(prepared, rif_kind)
    schema = T.StructType([T.StructField("comparison", T.StringType()), T.StructField("split", T.StringType()),
                           *dc.TERMS.fields])
    return _solve_blocks(sides, plan, schema, _decompositions)


def quantile_models(prepared: DataFrame, taus=TAUS) -> DataFrame:
    """Weighted quantile regressions of the log wage for all regular employees."""
    return quantile_regression(regular_employees(prepared)[0], "log_wage", [*CORE, "dummy_male"], list(taus), "Weight")
