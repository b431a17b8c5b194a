"""Tables against a plain per-slice computation in Python, and the special rules one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.operators import tabulate as tb
from surveyspark.operators.populations import population
from surveyspark.plans import catalogue as ct
from surveyspark.plans import report_tables as rt
from surveyspark.plans import workflow as wf
from surveyspark.runtime import materialise
from surveyspark.sources import sinks
from tests import invented


@pytest.fixture(scope="module")
def prepared(spark):
    return materialise(wf.prepared(*invented.frames(spark)))


@pytest.fixture(scope="module")
def cells(prepared):
    return materialise(ct.report_cells(prepared))


POPULATIONS = {
    "All persons": lambda r: True, "Workers": lambda r: r["Worker"], "Labour force": lambda r: r["Labour_force"],
    "Employees": lambda r: r["Status_used"] in (31, 41, 51),
    "Formal trainees in labour force": lambda r: r["Labour_force"] and r["Training_code"] == "1",
    "Principal unemployed": lambda r: r["Principal_status"] == 81, "Unemployed": lambda r: r["Unemployed"],
    "Non-workers": lambda r: not r["Worker"],
}


def naive_slices(rows, spec):
    for age in spec.ages:
        g = cb.AGE_GROUPS[age]
        for sector in ("Rural", "Urban", "Rural + Urban"):
            if sector == "Rural + Urban" and not spec.combined:
                continue
            chosen = [r for r in rows if POPULATIONS[spec.population](r) and r["Age"] >= g.lower
                      and (g.upper is None or r["Age"] <= g.upper)
                      and (sector == "Rural + Urban" or r["Sector_code"] == cb.SECTORS[sector])]
            codes = sorted({r[spec.group] for r in chosen if r[spec.group] is not None}) if spec.group else [None]
            for code in codes:
                members = [r for r in chosen if spec.group is None or r[spec.group] == code]
                if members:
                    yield (age, sector, code), members


def naive(rows, spec):
    out = {}
    for head, members in naive_slices(rows, spec):
        def of(g, pool=members):
            return [r for r in pool if g in ("Persons", r["Gender"])]

        def weight(pool):
            return sum(r["Weight"] for r in pool)

        if spec.kind == ct.RATES:
            for g in cb.GENDERS:
                everyone, labour = weight(of(g)), weight([r for r in of(g) if r["Labour_force"]])
                out[head, None, g, "n"] = len(of(g))
                out[head, None, g, "weighted"] = everyone
                out[head, None, g, "LFPR"] = 100 * labour / everyone if everyone else None
                out[head, None, g, "WPR"] = 100 * weight([r for r in of(g) if r["Worker"]]) / everyone if everyone else None
                out[head, None, g, "UR"] = 100 * weight([r for r in of(g) if r["Unemployed"]]) / labour if labour else None
        elif spec.kind == ct.MEANS:
            for g in cb.GENDERS:
                known = [r for r in of(g) if r["Household_monthly_spending"] is not None]
                out[head, None, g, "n"] = len(known)
                out[head, None, g, "mean"] = (sum(r["Weight"] * r["Household_monthly_spending"] for r in known) / weight(known)
                                              if known else None)
        else:
            answered = [r for r in members if r[spec.column] is not None]
            if not answered:
                continue
            codes = {c: (c,) for c in sorted({r[spec.column] for r in answered})}
            if spec.column == "Broad_status":
                codes = {"1": ("1",), "2": ("2",), "3": ("3",), "4": ("4",), "self": ("1", "2")}
            for g in cb.GENDERS:
                total = weight(of(g, answered))
                for code, parts in codes.items():
                    share = weight([r for r in of(g, answered) if r[spec.column] in parts])
                    out[head, code, g, "share"] = 100 * share / total if total else None
                out[head, "total", g, "share"] = 100.0 if total else None
    return out


def test_every_sheet_equals_the_slice_by_slice_result(prepared, cells):
    rows = prepared.collect()
    got = {}
    for r in cells.collect():
        got.setdefault(r["sheet"], {})[(r["Age_group"], r["Sector"], r["group_code"]), r["code"], r["gender"], r["measure"]] = r["value"]
    assert len(ct.CATALOGUE) == 31
    for spec in ct.CATALOGUE:
        want = naive(rows, spec)
        assert set(got.get(spec.sheet, {})) == set(want), spec.sheet
        for key, value in want.items():
            assert got[spec.sheet][key] == (None if value is None else pytest.approx(value, abs=1e-9)), (spec.sheet, key)


def test_one_pass_equals_the_single_table_operators(prepared, cells):
    def as_set(df):
        return {tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()}

    columns = ["Age_group", "Sector", "Social_group", "Code", "Broad_status", *cb.GENDERS]
    one = ct.sheet(cells, "employment_social_group").select(*columns)
    single = tb.weighted_shares(prepared, "Broad_status", ["All ages", "15+"], "Workers", "Social_group").select(*columns)
    assert as_set(one) == as_set(single)
    columns = ["Age_group", "Sector", "State_code", "Gender", "Sample_persons", "LFPR", "WPR", "UR"]
    one = ct.sheet(cells, "rates_state_youth").withColumn("Sample_persons", F.col("Sample_persons").cast("long")).select(*columns)
    assert as_set(one) == as_set(tb.weighted_rates(prepared, ["15-29"], "State_code").select(*columns))
    columns = ["Age_group", "Sector", "Gender", "Mean_rupees"]
    assert as_set(ct.sheet(cells, "mean_HH_spending").select(*columns)) == as_set(
        tb.weighted_means(prepared, "Household_monthly_spending").select(*columns))


def test_scale_order_and_partitions_do_not_matter(prepared, cells):
    shuffled = prepared.withColumn("Weight", F.col("Weight") * 1000).repartition(7, "PID")
    same = ct.report_cells(shuffled, ct.CATALOGUE).filter("measure not in ('weighted')")
    key = ["sheet", "Age_group", "Sector", "group_code", "code", "gender", "measure"]
    a = {tuple(r[k] for k in key): r["value"] for r in cells.filter("measure not in ('weighted')").collect()}
    b = {tuple(r[k] for k in key): r["value"] for r in same.collect()}
    assert set(a) == set(b)
    for k, v in a.items():
        assert b[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9))


def test_shares_total_100_and_sheet_order(prepared, tmp_path, spark, cells):
    table = tb.weighted_shares(prepared, "Broad_status", ["15+"])
    gaps = [r["max_gap"] for r in tb.share_totals(table, ["Age_group", "Sector"]).collect()]
    assert max(g or 0 for g in gaps) < 1e-9
    ordered = sinks.in_sheet_order(table).filter("Sector = 'Rural'").select("Code").collect()
    assert [r[0] for r in ordered] == ["1", "2", "self", "3", "4", "total"]
    sinks.write_report(cells, str(tmp_path / "cells"))
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.count() == cells.count() and back.select("sheet").distinct().count() == 31


def test_unknown_population_and_repeated_sheet(prepared):
    with pytest.raises(ValueError, match="unknown population"):
        population("Everybody")
    with pytest.raises(ValueError, match="unique"):
        ct.fine_cells(prepared, [ct.CATALOGUE[3], ct.CATALOGUE[3]])


def test_crosstab_margins_and_oneway(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 4.0), (None, "x", 9.0)], "r string, c string, Weight double")
    got = {(r["r"], r["c"]): (r["weighted"], r["percent"]) for r in tb.crosstab(df, "r", "c", "row").collect()}
    assert got[("a", "y")] == (3.0, 75.0) and got[("Total", "x")] == (5.0, 62.5) and got[("b", "Total")] == (4.0, 100.0)
    got = {(r["r"], r["c"]): r["percent"] for r in tb.crosstab(df, "r", "c", "cell").collect()}
    assert got[("b", "x")] == 50.0 and got[("Total", "Total")] == 100.0
    rows = {r["c"]: (r["weighted"], r["percent"], r["cumulative"]) for r in tb.oneway(df, "c").collect()}
    assert rows["x"][0] == 14.0 and rows["y"][2] == pytest.approx(100.0)
    missing = {r["r"]: r["n"] for r in tb.crosstab_counts(df, "r").collect()}
    assert missing == {"a": 2, "b": 1, None: 1}


@pytest.mark.parametrize("kind", ["iweight", "aweight"])
def test_summary_keeps_its_digits(spark, kind):
    """Means far larger than the spread, groups far from each other, weightless and single rows, in one pass."""
    rng = np.random.default_rng(4)
    groups = {"far": 1e9 + rng.normal(size=500), "near": rng.normal(size=300), None: rng.normal(size=40) * 1e-3 - 1e6, "one": np.array([5.0])}
    rows = [(g, float(x), float(w)) for g, xs in groups.items() for x, w in zip(xs, rng.uniform(0.5, 2, len(xs)))]
    df = spark.createDataFrame([*rows, ("void", 3.0, 0.0), ("void", 4.0, 0.0), ("far", None, 1.0), ("far", 2.0, None)], "g string, x double, w double").repartition(4)
    table = tb.weighted_summary(df, "x", "w", ["g"], weight_kind=kind)
    got = {r["g"]: r for r in table.collect()}
    for g in ("far", "near", None):
        x, w = (np.array([r[i] for r in rows if r[0] == g], np.longdouble) for i in (1, 2))
        mean = (w * x).sum() / w.sum()
        observations = w.sum() if kind == "iweight" else len(x)
        sd = np.sqrt((w * (x - mean) ** 2).sum() / w.sum() * observations / (observations - 1))
        assert got[g]["n"] == len(x) and got[g]["mean"] == pytest.approx(float(mean), rel=1e-13)
        assert got[g]["sd"] == pytest.approx(float(sd), rel=1e-7) and got[g]["min"] == float(x.min())
    assert (got["void"]["n"], got["void"]["mean"], got["void"]["sd"]) == (2, None, None)
    assert (got["one"]["mean"], got["one"]["n"]) == (5.0, 1)
    # Once in the final plan and once in the initial one.
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(group") == 2


def test_report_tables_equal_slice_by_slice_shares(spark):
    """Every historical table from the one pass against a plain count over the collected rows."""
    prepared = wf.prepared(*invented.frames(spark), mode="video")
    rows = [r.asDict() for r in rt.historical_columns(prepared).withColumns(
        {f"in {p}": population(p) for p in {t.people for t in rt.TABLES}}).collect()]
    got = {}
    for r in rt.report_tables(prepared).collect():
        key = tuple(r[c] for c in ("table", "Age_group", "Sector", "Gender", "group", "code", "weighting"))
        assert key not in got
        got[key] = (r["n"], r["percent"], r["running"])
    want = {}
    for t in rt.TABLES:
        for age in t.ages:
            lo, hi = cb.AGE_GROUPS[age].lower, cb.AGE_GROUPS[age].upper or 999
            inside = [r for r in rows if r[f"in {t.people}"] and r[t.column] is not None and lo <= r["Age"] <= hi and (not t.group or r[t.group] is not None)]
            for sector, own in [*cb.SECTORS.items(), *([(cb.POOLED_SECTOR, None)] if t.pooled else [])]:
                for gender in ("Male", "Female", "Persons"):
                    part = [r for r in inside if own in (None, r["Sector_code"]) and gender in ("Persons", r["Gender"])]
                    groups = sorted({str(r[t.group]) for r in part}) + (["Total"] if t.total and part else []) if t.group else [None]
                    for group in groups:
                        mine = [r for r in part if group in (None, "Total") or str(r[t.group]) == group]
                        for weighting, w in rt.WEIGHTS.items():
                            total, upto = sum(r[w] for r in mine), 0.0
                            for code in sorted({str(r[t.column]) for r in mine}):
                                hit = [r[w] for r in mine if str(r[t.column]) == code]
                                upto += sum(hit)
                                if t.only in (None, code):
                                    want[t.name, age, sector, gender, group, code, weighting] = (
                                        len(hit), 100 * sum(hit) / total, 100 * upto / total if t.running else None)
    assert set(got) == set(want) and len(want) > 500
    for key, (n, percent, running) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(percent)
        assert (got[key][2] is None) == (running is None) and (running is None or got[key][2] == pytest.approx(running))
