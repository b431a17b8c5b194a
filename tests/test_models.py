import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import decompose as dc
from surveyspark.operators import ordered as od
from surveyspark.operators import quantreg as qr
from surveyspark.operators import regression as rg
from surveyspark.plans import wage_models as wm
from surveyspark.plans import workflow as wf
from tests import invented


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 900
    age = rng.integers(15, 70, n).astype(float)
    urban, female = (rng.random(n) < 0.4).astype(float), (rng.random(n) < 0.45).astype(float)
    y = 8 + 0.05 * age - 0.0004 * age ** 2 + 0.3 * urban - 0.2 * female - 0.1 * urban * female + rng.normal(0, 0.5, n)
    w = rng.uniform(0.5, 4, n)
    block = np.where(np.arange(n) % 3 == 0, "a", "b")
    columns = ["y", "age", "age2", "urban", "female", "w", "block"]
    rows = [(float(y[i]), float(age[i]), float(age[i] ** 2), float(urban[i]), int(female[i]), float(w[i]), str(block[i])) for i in range(n)]
    return spark.createDataFrame(rows, columns).repartition(5), {c: np.array([r[j] for r in rows]) for j, c in enumerate(columns)}


def wls(y, x, w):
    z = np.column_stack([*x, np.ones(len(y))])
    beta = np.linalg.solve(z.T @ (z * w[:, None]), z.T @ (w * y))
    r = y - z @ beta
    scaled = w * len(y) / w.sum()
    s2 = (scaled * r * r).sum() / (len(y) - z.shape[1])
    return beta, np.sqrt(np.diag(np.linalg.inv(z.T @ (z * scaled[:, None]))) * s2)


def test_regression_matches_numpy(data):
    df, a = data
    x = ["age", "age2", "urban", "female"]
    got = rg.regress(df, "y", x, "w").collect()
    beta, se = wls(a["y"], [a[c] for c in x], a["w"])
    assert [r["estimate"] for r in got] == pytest.approx(beta, rel=1e-8)
    assert [r["std_error"] for r in got] == pytest.approx(se, rel=1e-7)


def test_collinear_terms_are_reported_not_solved(data):
    df, a = data
    df = df.withColumn("rural", 1 - F.col("urban")).withColumn("zero", F.lit(0.0))
    got = {r["term"]: r for r in rg.regress(df, "y", ["age", "urban", "rural", "zero"], "w").collect()}
    assert got["rural"]["omitted"] and got["zero"]["omitted"] and not got["urban"]["omitted"]
    beta, _ = wls(a["y"], [a["age"], a["urban"]], a["w"])
    assert got["urban"]["estimate"] == pytest.approx(beta[1], rel=1e-9)


def test_many_groups_in_one_pass(data):
    df, a = data
    got = {(r["block"], r["term"]): r["estimate"] for r in rg.regress(df, "y", ["age"], by=["block"]).collect()}
    for block in ("a", "b"):
        m = a["block"] == block
        beta, _ = wls(a["y"][m], [a["age"][m]], np.ones(m.sum()))
        assert got[block, "age"] == pytest.approx(beta[0], rel=1e-9)


def test_wide_design(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40))
    y = x @ np.arange(40) + 1
    df = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, x)], ["y", *[f"x{i}" for i in range(40)]])
    got = rg.regress(df, "y", [f"x{i}" for i in range(40)]).collect()
    assert [r["estimate"] for r in got] == pytest.approx([*range(40), 1.0], abs=1e-7)


def test_decomposition_adds_up(data):
    df, a = data
    x = ["age", "age2", "urban"]
    rows = dc.oaxaca(df, "y", x, "female", "w", detail=True).collect()
    total = {r["part"]: r["estimate"] for r in rows if r["term"] == dc.ALL_TERMS}
    gap = np.average(a["y"][a["female"] == 0], weights=a["w"][a["female"] == 0]) - np.average(
        a["y"][a["female"] == 1], weights=a["w"][a["female"] == 1])
    assert total["difference"] == pytest.approx(gap)
    assert total["endowments"] + total["coefficients"] + total["interaction"] == pytest.approx(gap)
    for part in ("endowments", "coefficients", "interaction"):
        assert sum(r["estimate"] for r in rows if r["part"] == part and r["term"] != dc.ALL_TERMS) == pytest.approx(total[part])
    two = {r["part"]: r["estimate"] for r in dc.oaxaca(df, "y", x, "female", "w", pooled=True).collect()}
    assert two["explained"] + two["unexplained"] == pytest.approx(gap)
    pooled, _ = wls(a["y"], [a[c] for c in (*x, "female")], a["w"])
    shift = [np.average(a[c][a["female"] == 0], weights=a["w"][a["female"] == 0])
             - np.average(a[c][a["female"] == 1], weights=a["w"][a["female"] == 1]) for c in x]
    assert two["explained"] == pytest.approx(float(np.dot(shift, pooled[:3])))


def brute_percentile(y, w, p):
    order = np.argsort(y)
    ys, ws = y[order], w[order]
    running = np.cumsum(ws)
    target = p * running[-1]
    for i, r in enumerate(running):
        if abs(r - target) <= 1e-12 * target:
            later = ys[ys > ys[i]]
            return (ys[i] + later[0]) / 2 if len(later) and (i + 1 == len(ys) or ys[i + 1] != ys[i]) else ys[i]
        if r > target:
            return ys[i]


@pytest.mark.parametrize("settings", [{}, {"ranges": 4, "small_range": 3}])
def test_percentiles_against_brute_force(spark, data, settings):
    df, a = data
    got = {(r["block"], r["p"]): r["value"] for r in od.weighted_percentiles(df, "y", [0.1, 0.5, 0.9], "w", ["block"], **settings).collect()}
    for block, p in itertools.product("ab", (0.1, 0.5, 0.9)):
        m = a["block"] == block
        assert got[block, p] == brute_percentile(a["y"][m], a["w"][m], p)
    ties = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (9.0, 1.0), (None, 5.0), (4.0, 0.0)], "y double, w double")
    got = {r["p"]: r["value"] for r in od.weighted_percentiles(ties, "y", [0.25, 0.5, 0.6], "w", **settings).collect()}
    assert got == {0.25: 1.5, 0.5: 2.5, 0.6: 3.0}


@pytest.mark.parametrize("ranges", [2, 8])
def test_percentiles_of_unlike_groups_and_infinite_values(spark, ranges):
    """A hot group far from the others, infinities at both ends and the largest finite numbers."""
    rng = np.random.default_rng(8)
    groups = {"hot": 1e9 + rng.normal(size=400), "low": rng.normal(size=30), None: np.array([-np.inf] * 5 + [1.0, 2.0, 3.0, np.inf]),
              "wide": np.array([-1.7e308, -1.0, 0.0, 1.0, 1.7e308] * 9), "none": np.array([-np.inf] * 4)}
    rows = [(g, float(y), float(w)) for g, ys in groups.items() for y, w in zip(ys, rng.uniform(0.5, 2, len(ys)))]
    df = spark.createDataFrame(rows, "g string, y double, w double").repartition(4)
    got = {(r["g"], r["p"]): r["value"] for r in od.weighted_percentiles(df, "y", [0.2, 0.5, 0.9], "w", ["g"], ranges=ranges, small_range=10).collect()}
    for g in groups:
        y, w = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        for p in (0.2, 0.5, 0.9):
            assert got[g, p] == brute_percentile(y, w, p)


def test_percentiles_with_one_value_on_most_rows(spark):
    rows = [(5.0, 1.0)] * 800 + [(float(v), 1.0) for v in range(10, 110)] + [(-1.0, 1.0)] * 100
    got = od.weighted_percentiles(spark.createDataFrame(rows, "y double, w double"), "y", [0.05, 0.5, 0.95], "w", ranges=8, small_range=10)
    assert {r["p"]: r["value"] for r in got.collect()} == {0.05: -1.0, 0.5: 5.0, 0.95: 59.5}


def test_influence_variables(spark, data):
    df, a = data
    wide, q = od.add_rif(df, "y", [0.25], "w", kind="standard")
    m = wide.agg(F.sum(F.col("w") * F.col("rif25")) / F.sum("w")).first()[0]
    assert m == pytest.approx(q[0.25], abs=0.02), "the weighted mean of the influence variable is the quantile"
    with_gap = df.withColumn("y", F.when(F.col("age") > 60, None).otherwise(F.col("y")))
    wide, q = od.add_rif(with_gap, "y", [0.25], "w")
    assert wide.filter("y is null").select("rif25").distinct().collect()[0][0] == q[0.25]


def test_quantile_regression_share_and_objective(spark, data):
    df, a = data
    rows = qr.quantile_regression(df, "y", ["age", "urban"], [0.25, 0.5, 0.9], "w").collect()
    for r in rows:
        assert r["converged"] and abs(r["share_below"] - r["tau"]) < 5e-3


@pytest.mark.parametrize("points", [8192, 6])
def test_quantile_regression_against_all_vertices(spark, points):
    rng = np.random.default_rng(5)
    n = 24
    x, y, w = rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 2, n)
    y = y + x
    df = spark.createDataFrame([(float(p), float(q), float(r)) for p, q, r in zip(y, x, w)], ["y", "x", "w"])
    got = {r["tau"]: r["objective"] for r in qr.quantile_regression(df, "y", ["x"], [0.3, 0.5], "w", points=points).collect()}
    for tau in (0.3, 0.5):
        best = np.inf
        for i, j in itertools.combinations(range(n), 2):
            slope = (y[i] - y[j]) / (x[i] - x[j])
            r = y - (y[i] - slope * x[i]) - slope * x
            best = min(best, float(w @ (r * (tau - (r < 0)))))
        assert got[tau] == pytest.approx(best, rel=1e-9)


@pytest.mark.parametrize("parts", [1, 5, 8, 24])
def test_quantile_search_goes_on_after_a_missed_draw(spark, parts):
    """Draws of some six rows often miss the plane, whatever way the rows are dealt: the search must not end in ever smaller draws."""
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=24), rng.normal(size=24), rng.uniform(0.5, 2, 24)
    df = spark.createDataFrame([(float(q + p), float(p), float(r)) for p, q, r in zip(x, y, w)], ["y", "x", "w"]).repartitionByRange(parts, "x")
    rows = qr.quantile_regression(df, "y", ["x"], [0.3, 0.5], "w", points=6).collect()
    assert all(r["converged"] and r["passes"] <= 30 for r in rows)


def test_share_of_a_search_stays_above_that_of_all_rows():
    """Missed draws shrank the share without end, until no row was drawn any more."""
    frame = qr._Frame([0, 1], np.zeros(2), np.ones(2), np.eye(2), 24, 24.0)
    search = qr._Search(0.5, np.zeros(2), half=1e-8, share=0.25)
    nothing = (np.zeros((0, 2)), np.zeros(0), np.zeros(0, int))
    for inside in (2.0, 2.0, 2.0, 24.0):
        qr._advance(search, frame, np.array([0.0, 0.0, inside, inside, 0.0, 0.0, 0.0]), nothing, 6)
    assert search.share >= 0.25 and search.half > 1e-5


def _hard_rows(n=3000):
    """Ties, a third of all rows alike, a dummy that three rows have, a column that others explain."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 40, n).astype(float)
    rare = np.zeros(n)
    rare[:3] = 1
    y = np.round(2 + 0.5 * x + 7 * rare + rng.standard_t(3, n), 1)
    w = rng.uniform(0.5, 2, n)
    x[n // 3: 2 * n // 3], y[n // 3: 2 * n // 3] = 11.0, 7.0
    return x, rare, y, w


@pytest.mark.parametrize("points", [8192, 100])
def test_quantile_regression_is_the_minimum(spark, points):
    x, rare, y, w = _hard_rows()
    rows = [tuple(map(float, r)) for r in zip(y, x, rare, 2 * x + 1, w)]
    rows += [(None, 1.0, 0.0, 3.0, 1.0), (1.0, None, 0.0, 3.0, 1.0), (500.0, 1.0, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, ["y", "x", "rare", "twice", "w"]).repartition(4)
    got = qr.quantile_regression(df, "y", ["x", "rare", "twice"], [0.1, 0.5, 0.9], "w", points=points).collect()
    z = np.c_[x, rare, np.ones(len(x))]
    for tau in (0.1, 0.5, 0.9):
        fit = {r["term"]: r for r in got if r["tau"] == tau}
        assert fit["twice"]["estimate"] == 0 and fit["x"]["n"] == len(x) and fit["x"]["passes"] <= 15
        r = y - z @ np.array([fit[t]["estimate"] for t in ("x", "rare", "_cons")])
        loss = float(w @ (r * (tau - (r < 0))))
        assert fit["x"]["objective"] == pytest.approx(loss, rel=1e-9)
        # No direction through the plane's own rows, nor any of many others, lowers the loss.
        for move in np.random.default_rng(1).normal(size=(300, 3)) * 1e-3:
            s = r - z @ move
            assert float(w @ (s * (tau - (s < 0)))) >= loss * (1 - 1e-10)


def test_quantile_regression_of_one_dummy_is_exact(spark):
    """The quantile of each group, to the last digits, with bands far smaller than the table."""
    n = 2001
    rng = np.random.default_rng(2)
    y, group = rng.lognormal(3, 1, n), (rng.random(n) < 0.4).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, group)], ["y", "g"])
    got = {r["term"]: r["estimate"] for r in qr.quantile_regression(df, "y", ["g"], [0.9], points=64).collect()}
    low, high = (np.sort(y[group == g])[int(np.ceil(0.9 * (group == g).sum())) - 1] for g in (0, 1))
    assert got["_cons"] == pytest.approx(low, rel=1e-12) and got["g"] == pytest.approx(high - low, rel=1e-9)


def test_quantile_regression_refuses(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["y", "x"])
    with pytest.raises(ValueError, match="between 0 and 1"):
        qr.quantile_regression(df, "y", ["x"], [1.0])
    with pytest.raises(ValueError, match="empty"):
        qr.quantile_regression(df.filter(F.lit(False)), "y", ["x"], [0.5])
    one = qr.quantile_regression(df, "y", ["x"], [0.5]).collect()
    assert {r["term"]: r["estimate"] for r in one} == {"x": 0.0, "_cons": 1.0}


def test_wage_models_equal_separate_regressions(spark):
    """The one-pass model blocks against single regressions on the same rows."""
    persons, households = invented.survey()
    rng = np.random.default_rng(2)
    extra_h, extra_p = [], []
    for h in range(7, 60):
        number = f"{h:02d}"
        extra_h.append(invented.household(number, b3q4_hhv1=["1", "2", "3", "9"][h % 4]))
        for s in range(1, 8):
            wage = None if rng.random() < 0.05 else str(int(rng.integers(5000, 60000)))
            extra_p.append(invented.person(
                number, f"{s:02d}", **invented.job("31"), b4q5_perv1=str(1 + int(rng.integers(0, 2))), b6q9_perv1=wage,
                b4q6_perv1=str(int(rng.integers(18, 60))), b4q7_perv1=str(1 + int(rng.integers(0, 3))),
                b4q8_perv1=str(rng.choice([5, 7, 8, 10, 11, 13]))))
    prepared = wf.prepared(*invented.frames(spark, (persons + extra_p, households + extra_h)), mode="video")
    table = wm.model_table(prepared).cache()
    got = wm.regressions(prepared).collect()
    names = {(r["comparison"], r["weighting"], r["y"]) for r in got}
    assert len(names) == 2 + 3 + 3 * 4
    single = rg.regress(table.filter(F.col("Social_group").isin("1", "2", "9")).withColumn("indicator", 1 - F.col("dummy_scst")),
                        "rif75", ["indicator", *wm.CORE, "dummy_male"]).collect()
    block = [r for r in got if (r["comparison"], r["y"]) == ("scst_vs_others", "rif75")]
    assert [r["term"] for r in block] == [r["term"] for r in single]
    assert [r["estimate"] for r in block] == pytest.approx([r["estimate"] for r in single], rel=1e-6, abs=1e-9)
    assert block[0]["n"] == single[0]["n"] > [r for r in got if (r["comparison"], r["y"]) == ("scst_vs_others", "log_wage")][0]["n"]
    gaps = wm.decompositions(prepared).collect()
    assert len({(r["comparison"], r["split"], r["y"]) for r in gaps}) == 4 * 4 + 2
    one = {r["part"]: r["estimate"] for r in dc.oaxaca(table, "log_wage", list(wm.CORE), "dummy_female", "Weight").collect()}
    mine = {r["part"]: r["estimate"] for r in gaps if (r["comparison"], r["split"], r["y"], r["term"]) == ("gender", "threefold", "log_wage", dc.ALL_TERMS)}
    assert mine == pytest.approx(one, rel=1e-7)
    table.unpersist()


def test_influence_variables_read_their_input_once(data):
    # The result comes from written files: df itself is not evaluated again.
    rows, _ = od.add_rif(data[0], "y", [0.25, 0.5], "w", kind="standard")
    assert rows.inputFiles() and set(data[0].columns) < set(rows.columns)


def test_decomposition_reads_its_input_once(data):
    assert dc.oaxaca(data[0], "y", ["age"], "female", "w", detail=True).inputFiles()


def test_regression_reads_its_input_once(data):
    assert rg.regress(data[0], "y", ["age", "urban"], "w").inputFiles()
