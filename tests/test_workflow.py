import pytest
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import recode, status
from surveyspark.operators import checks as ck
from surveyspark.operators import merge as mg
from surveyspark.plans import workflow as wf
from surveyspark.plans.queries import QUERIES
from surveyspark.runtime import RunFolder
from surveyspark.sources import coded, sinks
from tests import invented


@pytest.fixture(scope="module")
def prepared(spark):
    persons, households = invented.frames(spark)
    visits = wf.first_visits(persons, households)
    rows = wf.derive_categories(visits.data).collect()
    return {r["PID"][-4:]: r for r in rows}, visits.audit.first()


def test_csv_reader_keeps_text(spark, tmp_path):
    invented.write_csv(tmp_path)
    persons, households = coded.read_first_visit_files(spark, str(tmp_path), wages=True)
    expected, _ = invented.frames(spark)
    assert sorted(map(str, persons.collect())) == sorted(map(str, expected.collect()))
    assert "extra" not in persons.columns
    assert persons.filter("b5pt1q13_perv1 = 'NA'").count() == 1
    assert households.filter("b1q15_hhv1 = '01'").count() == 1


def test_reader_failures(spark, tmp_path):
    with pytest.raises(coded.BadInput):
        coded.read_coded_csv(spark, str(tmp_path / "absent.csv"), ["a"])
    (tmp_path / "x.csv").write_text("a,b\n")
    with pytest.raises(coded.BadInput, match="lacks"):
        coded.read_coded_csv(spark, str(tmp_path / "x.csv"), ["A"])
    with pytest.raises(coded.BadInput, match="no records"):
        coded.read_coded_csv(spark, str(tmp_path / "x.csv"), ["a"])


def test_job_choice_and_flags(prepared):
    rows, _ = prepared
    both = rows["0101"]
    assert both["Worker"] and not both["Unemployed"] and both["Broad_status"] == "2" and both["NIC"] == "47110"
    assert rows["0102"]["Unemployed"] and rows["0102"]["Broad_status"] is None
    assert rows["0103"]["Social_security"] is None, "a blank detail of the principal job stays blank"
    assert rows["0104"]["Status_used"] == 11 and rows["0104"]["Economic_months"] == "2"
    assert rows["0201"]["Gender"] == "Male" and rows["0201"]["Gender_original"] == "3"
    assert rows["0201"]["Attendance_group"] == "16", "a code outside the bands is kept"


def test_weights_and_bands(prepared):
    rows, audit = prepared
    assert rows["0101"]["Weight"] == pytest.approx(12345 / 200 / 4)
    assert rows["0301"]["Weight"] == pytest.approx(7.77)
    assert rows["0401"]["Weight"] == pytest.approx(100001 / 200 / 3)
    bands = [rows[k]["Household_spending_band"] for k in ("0101", "0201", "0301", "0401", "0501", "0601")]
    assert bands == ["1", "2", "2", None, "6", None]
    broad = [rows[f"05{i:02d}"]["NIC_broad"] for i in range(1, 19)]
    assert broad == ["1", "1", "2", "2", "3", "3", "4", "4", "5", "5", "7", "7", "8", "8", "9", "9", "10", "10"]
    assert audit["persons_used"] == 28 and audit["gender_code_3_records"] == 1 and audit["households"] == 6
    assert audit["persons_with_fewer_than_four_quarters"] == 3
    assert audit["sum_of_weights"] == pytest.approx(sum(r["Weight"] for r in rows.values()))


def test_historical_mode(spark):
    visits = wf.first_visits(*invented.frames(spark), mode="video")
    rows = {r["PID"][-4:]: r["Weight"] for r in visits.data.collect()}
    assert "0201" not in rows
    import numpy as np
    assert rows["0401"] == float(np.float32(100001 / 200))


def test_first_nonblank_differs_from_selected(spark):
    df = spark.createDataFrame([(31, 41, "", "7"), (92, 11, None, "3"), (92, None, None, None)],
                               "Principal_status int, Subsidiary_status int, p string, s string")
    rows = df.select(status.first_nonblank("p", "s").alias("a"), status.selected_job("p", "s").alias("b")).collect()
    assert [tuple(r) for r in rows] == [("7", ""), ("3", "3"), (None, None)]


BROKEN = {
    "b1q1_perv1": lambda p, h: p[0].update(b1q1_perv1="1000"),
    "b1q14_hhv1": lambda p, h: h[0].update(b1q14_hhv1="x"),
    "qtr_perv1": lambda p, h: p[0].update(qtr_perv1="Q5"),
    "visit_perv1": lambda p, h: p[0].update(visit_perv1="V2"),
    "HHID repeated": lambda p, h: h.append(dict(h[0])),
    "PID repeated": lambda p, h: p.append(dict(p[0])),
    "b4q1_perv1 two digits": lambda p, h: p[0].update(b4q1_perv1="1"),
    "1 persons have no household": lambda p, h: p.append(invented.person("77", "01")),
    "1 households have no persons": lambda p, h: h.append(invented.household("78")),
    "state_perv1 = state_hhv1: 1 rows": lambda p, h: p[0].update(state_perv1="10"),
    "Multiplier finite": lambda p, h: [r.update(mult_perv1="0") for r in p] + [r.update(mult_hhv1="0") for r in h],
    "Contributing_quarters in 1-4": lambda p, h: [r.update(no_qtr_perv1="5") for r in p] + [r.update(no_qtr_hhv1="5") for r in h],
    "Age nonnegative": lambda p, h: p[0].update(b4q6_perv1="-3"),
    "Gender_original in 1-3": lambda p, h: p[0].update(b4q5_perv1="4"),
}


@pytest.mark.parametrize("message", BROKEN)
def test_every_file_check_stops_the_run(spark, message):
    persons, households = invented.survey()
    BROKEN[message](persons, households)
    with pytest.raises(ck.CheckFailed, match=message):
        wf.first_visits(*invented.frames(spark, (persons, households)))


@pytest.mark.parametrize("message, change", [
    ("Principal_status documented", dict(b5pt1q3_perv1="61")),
    ("Subsidiary_status documented", dict(b5pt2q3_perv1="81")),
    ("NIC of a worker has 5 digits", dict(b5pt1q3_perv1="11", b5pt1q5_perv1="0111", b5pt1q6_perv1="611")),
    ("NIC division of a worker documented", dict(b5pt1q3_perv1="11", b5pt1q5_perv1="34000", b5pt1q6_perv1="611")),
    ("NCO of a worker has 3 digits", dict(b5pt1q3_perv1="11", b5pt1q5_perv1="01110", b5pt1q6_perv1="6A1")),
])
def test_prepared_checks(spark, message, change):
    persons, households = invented.survey()
    persons[9].update(change)
    prepared = wf.prepared(*invented.frames(spark, (persons, households)))
    failed = dict(ck.enforce(ck.check_report(prepared, wf.prepared_checks()), strict=False))
    assert failed[message] == 1
    assert {r["PID"][-4:] for r in ck.violations(prepared, wf.prepared_checks()).collect()} == {"0601"}


def test_bad_number_stops_the_job(spark):
    persons, households = invented.survey()
    persons[0]["b4q6_perv1"] = "forty"
    with pytest.raises(Exception, match="not a number"):
        wf.prepared(*invented.frames(spark, (persons, households))).collect()


def test_merge_with_hot_and_missing_keys(spark):
    left = spark.createDataFrame([("a", i) for i in range(500)] + [(None, 1), ("z", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, w int")
    merged = mg.merge_tables(left, right, ["k"], "m:1")
    counts = {r["_merge"]: r["rows"] for r in mg.merge_counts(merged).collect()}
    assert counts == {"both": 500, "left_only": 2, "right_only": 2}
    flipped = mg.merge_tables(right, left, ["k"], "1:m")
    counts = {r["_merge"]: r["rows"] for r in mg.merge_counts(flipped).collect()}
    assert counts == {"both": 500, "left_only": 2, "right_only": 2}
    with pytest.raises(ck.CheckFailed, match="right key repeated"):
        mg.merge_checked(left.filter("k = 'a'"), right.union(right), ["k"])


def test_merge_finds_unmatched_keys_without_sorting_them(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("z", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, w int")
    merged = mg.merge_tables(left, right, ["k"], "m:1").filter(F.col("_merge") == mg.RIGHT_ONLY)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [k" in plan and "LeftAnti" in plan and "Sort" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, merged.select("w", "k", "v").collect())) == [(20, "b", None), (30, None, None)]
    # Rows that are on both sides need no anti join.
    both = mg.merge_tables(left, right, ["k"], "m:1").filter(F.col("_merge") == mg.BOTH)
    assert "LeftAnti" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 50


@pytest.mark.parametrize("repeats", [False, True])
def test_agreement_is_the_outer_merge_in_one_unsorted_join(spark, tmp_path, repeats):
    many = [(1, "F", 7, "d"), (1, "O", 7, None), (1, "F", None, "d"), (2, "F", 3, "d"), (None, "F", 1, "d"), (9, "F", 1, "d")]
    many += [(5, "O", i % 3, "e") for i in range(300)]
    one = [(1, "F", 7, "d"), (2, "O", 3, None), (None, "F", 1, "d"), (4, "F", 4, "d"), (5, "O", 2, "e")] + [(5, "O", 1, "d")] * repeats
    left = spark.createDataFrame(many, "l_orderkey int, l_linestatus string, l_suppkey int, l_shipdate string")
    right = spark.createDataFrame(one, "o_orderkey int, o_orderstatus string, o_custkey int, o_orderdate string")
    left.write.parquet(f"{tmp_path}/lineitem.parquet")
    right.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["agreement_counts"](spark, str(tmp_path))
    # The sorts and hash aggregates of two joins held some ten times the memory.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Sort" not in plan
    pairs = [("l_linestatus", "o_orderstatus"), ("l_suppkey", "o_custkey"), ("l_shipdate", "o_orderdate")]
    merged = mg.merge_tables(left.withColumnRenamed("l_orderkey", "k"), right.withColumnRenamed("o_orderkey", "k"), ["k"])
    wanted = {r["check"]: r["violations"] for r in ck.check_report(merged, [
        ck.Check(f"{a} = {b}", F.col(a) == F.col(b)) for a, b in pairs]).collect()}
    assert {r["check"]: r["violations"] for r in got.collect()} == wanted
    assert repeats or wanted == {"l_linestatus = o_orderstatus": 6, "l_suppkey = o_custkey": 205, "l_shipdate = o_orderdate": 6}
    flipped = mg.agreement(right.withColumnRenamed("o_orderkey", "k"), left.withColumnRenamed("l_orderkey", "k"), ["k"],
                           [(b, a) for a, b in pairs], "1:m")
    assert sorted(r["violations"] for r in flipped.collect()) == sorted(wanted.values())


def test_agreement_of_coded_files_derives_each_file_once(spark):
    plan = QUERIES["agreement_coded_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Persons read line items and orders, households orders and the keys of line items; no file is derived again for its keys.
    assert plan.count("FileScan parquet") == 6 and plan.count("FullOuter") == 1 and "LeftAnti" not in plan


@pytest.mark.parametrize("side", ["person", "household"])
def test_agreement_counts_unmatched_and_differing_files(spark, side):
    persons, households = invented.survey()
    (persons if side == "person" else households).append({
        **(persons[0] if side == "person" else households[0]), ("b1q15_perv1" if side == "person" else "b1q15_hhv1"): "99"})
    persons[1]["mult_perv1"] = None
    keyed = wf.key_files(*invented.frames(spark, (persons, households)))
    got = {r["check"]: r["violations"] for r in mg.agreement(*keyed, ["HHID"], wf.agreement_pairs()).collect()}
    assert got.pop("mult_perv1 = mult_hhv1") == 2 and set(got.values()) == {1}


def test_else_null_and_nonnumeric(spark):
    df = spark.createDataFrame([("01",), ("04",), (None,), ("99",)], "c string")
    rows = df.select(recode.band_code("c", cb.NIC_BROAD_BANDS).alias("keep"),
                     recode.band_code("c", cb.NIC_BROAD_BANDS, else_null=True).alias("null")).collect()
    assert [tuple(r) for r in rows] == [("1", "1"), ("04", None), (None, None), ("10", "10")]


def test_historical_weight_with_missing_counts(spark):
    from surveyspark.functions import weights
    df = spark.createDataFrame([(100.0, None, None), (100.0, 1.0, None), (100.0, 2.0, 2.0)],
                               "Multiplier double, NSS double, NSC double")
    rows = df.select(weights.historical_weight().alias("h"), weights.quarter_weight().alias("q")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.5), (0.5, 0.5), (1.0, 1.0)]


def test_microdata_never_overwrites_inputs(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_microdata(df, str(tmp_path / "in"), [str(tmp_path / "in")])
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_microdata(df, str(tmp_path), [str(tmp_path / "in")])
    sinks.write_microdata(df, str(tmp_path / "out"), [str(tmp_path / "in")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_stack_visits_keeps_both_sides(spark):
    first = mg.drop_suffix(spark.createDataFrame([("V1a", "9")], "HHID string, mult_hhv1 string"), "hhv1")
    again = mg.drop_suffix(spark.createDataFrame([("V2a", "8", "x")], "HHID string, mult_hhrv string, new_hhrv string"), "hhrv")
    rows = {tuple(r) for r in mg.stack_visits(first, again).select("HHID", "mult", "new").collect()}
    assert rows == {("V1a", "9", None), ("V2a", "8", "x")}


def test_metadata_labels(spark):
    df = spark.createDataFrame([("1",)], "Social_group string")
    field = recode.attach_metadata(df, {"Social_group": "Social group"}).schema["Social_group"]
    assert field.metadata["value_labels"]["1"] == "ST" and field.metadata["comment"] == "Social group"
    assert df.select(F.col("Social_group")).count() == 1


def test_file_report_lands_keys_only(spark, tmp_path):
    """The file checks read keys alone, so a report by itself writes no other column, and says the same."""
    persons, households = invented.frames(spark)
    broken = persons.withColumn("b1q3_perv1", F.lit("x")).unionByName(persons.limit(1))
    whole, keys = (wf.land(broken, households, RunFolder(spark, str(tmp_path / name)), keys_only=name == "keys") for name in ("whole", "keys"))
    assert keys.persons.columns == ["HHID", "PID"] and keys.households.columns == ["HHID"]
    assert sorted(wf.file_report(keys).collect()) == sorted(wf.file_report(whole).collect())
    assert dict(wf.file_report(keys).collect())["b1q3_perv1"] == persons.count()


def test_violations_evaluate_checks_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x > 2

    rows = spark.range(5).select("id", F.udf(seen, "boolean")("id").alias("fine"))
    bad = ck.violations(rows.withColumn("other", F.col("fine")), [ck.Check("a", F.col("fine")), ck.Check("b", F.col("id") != 1)])
    assert sorted((r.id, r.failed_checks) for r in bad.select("id", "failed_checks").collect()) == [(0, ["a"]), (1, ["a", "b"]), (2, ["a"])]
    assert calls.value == 5
