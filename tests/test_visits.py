"""Revisit files: reading, keys, the one layout that checks and merges share."""

import csv

import pytest

from surveyspark.operators.checks import CheckFailed
from surveyspark.plans import visits as vs
from surveyspark.sources.coded import BadInput

KEY = {"qtr": "Q1", "b1q3": "1", "b1q1": "00042", "b1q13": "1", "b1q14": "2", "b1q15": "07"}


def record(suffix, visit, person=None, nss="1", nsc="1", mult="1000", **more):
    upper = suffix.startswith("per")
    out = {**{f"{k}_{suffix}": v for k, v in KEY.items()}, f"visit_{suffix}": visit, f"{'NSS' if upper else 'nss'}_{suffix}": nss,
           f"{'NSC' if upper else 'nsc'}_{suffix}": nsc, f"mult_{suffix}": mult}
    if person:
        out[f"b4q1_{suffix}"] = person
    return out | {f"{k}_{suffix}": v for k, v in more.items()}


def files(**change):
    tables = {
        "hhv1": [record("hhv1", "V1", b3q2="3", b1q15="07"), record("hhv1", "V1", b3q2="4", b1q15="08")],
        "hhrv": [record("hhrv", v, nsc="2", b3q9="x") for v in ("V2", "V3", "V4")],
        "perv1": [record("perv1", "V1", p, b4q6=a) for p, a in (("01", "40"), ("02", "12"))],
        "perrv": [record("perrv", v, p, b4q6="41") for v in ("V2", "V3") for p in ("01", "02")]}
    return tables | change


def write(folder, tables):
    for name, rows in tables.items():
        columns = list(dict.fromkeys(c for r in rows for c in r))
        with open(folder / f"{name}.csv", "w", newline="") as out:
            writer = csv.DictWriter(out, columns)
            writer.writeheader()
            writer.writerows(rows)
    return str(folder)


def lay(spark, folder, tables):
    return vs.lay_out(*vs.read_visit_files(spark, write(folder, tables)), buckets=3)


def test_whole_workflow(spark, tmp_path):
    rows = vs.merged_visits(spark, write(tmp_path, files()), buckets=3).collect()
    got = {(r["Visit"], r["Household_number"], r["PID"] and r["PID"][-2:], r["_merge"]) for r in rows}
    assert got == {("V1", "07", "01", "both"), ("V1", "07", "02", "both"), ("V1", "08", None, "left_only"), ("V2", "07", "01", "both"),
                   ("V2", "07", "02", "both"), ("V3", "07", "01", "both"), ("V3", "07", "02", "both"), ("V4", "07", None, "left_only")}
    # The household's weight wins: 1000/200 where its counts differ.
    assert {(r["Visit"], r["weight"], r["weight_plain"], r["b3q9"]) for r in rows} == {
        ("V1", 10.0, 10.0, None), ("V2", 5.0, 10.0, "x"), ("V3", 5.0, 10.0, "x"), ("V4", 5.0, 10.0, "x")}


def test_nothing_is_shuffled_after_the_layout(spark, tmp_path):
    layout = lay(spark, tmp_path, files())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = {"stack": vs.stacked(layout.persons, ["HHID", "PID"], layout.added[1]), "attach": vs.attached(layout),
                  "repeats": vs.repeated_records(layout.persons, ["HHID", "PID"])}
        for name, df in frames.items():
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
        # Counts meet in one row per file; the rows themselves stay.
        plan = vs.key_report(layout.persons, ["HHID", "PID"])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(HHID" not in plan and "hashpartitioning(file" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    layout.drop()


def test_checks_find_what_is_wrong(spark, tmp_path):
    tables = files()
    tables["perrv"] += [record("perrv", "V2", "02"), record("perrv", "V1", "01"), record("perrv", "V3", "7"), record("perrv", None, "01")]
    layout = lay(spark, tmp_path, tables)
    report = {(r["file"], r["check"]): r["violations"] for r in vs.key_report(layout.persons, ["HHID", "PID"]).collect() if r["violations"]}
    assert report == {("revisit", "Visit"): 2, ("revisit", "Person_number"): 1, ("revisit", "PID missing"): 1, ("revisit", "PID repeated"): 1,
                      ("both", "PID in both files"): 1}
    assert {(r["PID"][-2:], r["times"]) for r in vs.repeated_records(layout.persons, ["HHID", "PID"]).collect()} == {("02", 2)}
    with pytest.raises(CheckFailed, match="revisit PID repeated: 1"):
        vs.enforce(layout)


def test_one_to_one_keeps_the_first_visit(spark, tmp_path):
    tables = files()
    tables["hhrv"].append(record("hhrv", "V1", mult="5", b3q2="9", b3q9="late"))
    tables["hhv1"][0]["b3q2_hhv1"] = None
    layout = lay(spark, tmp_path, tables)
    rows = {(r["Visit"], r["Household_number"]): r for r in vs.stacked(layout.households, ["HHID"], layout.added[0]).collect()}
    assert len(rows) == 5
    both = rows["V1", "07"]
    assert (both["_merge"], both["b3q2"], both["b3q9"], both["Multiplier"]) == ("both", None, "late", "1000")
    assert {k: r["_merge"] for k, r in rows.items() if k[0] != "V1"} == {(v, "07"): "right_only" for v in ("V2", "V3", "V4")}


def test_files_are_required(spark, tmp_path):
    tables = files()
    del tables["perrv"][0]["mult_perrv"], tables["perrv"][1]["mult_perrv"], tables["perrv"][2]["mult_perrv"], tables["perrv"][3]["mult_perrv"]
    with pytest.raises(BadInput, match="mult_perrv"):
        vs.read_visit_files(spark, write(tmp_path, tables))
    with pytest.raises(BadInput):
        vs.read_visit_files(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        vs.read_visit_files(spark, str(tmp_path), "xml")


def test_only_wanted_columns_are_written(spark, tmp_path):
    households, persons = vs.read_visit_files(spark, write(tmp_path, files()))
    written, _, added = vs.lay_out_level("households", households, ["b3q2", "b3q9"], buckets=3)
    assert set(written.columns) == {"HHID", "file", "b3q2", "b3q9"} and added == ("b3q9",)
    whole = vs.lay_out(households, persons, buckets=3)
    narrow = vs.lay_out(households, persons, buckets=3, columns=["b3q2", "b3q9", "b4q6", "weight"])
    columns = ["HHID", "PID", "b3q2", "b3q9", "b4q6", "weight", "_merge"]
    assert sorted(map(str, vs.attached(narrow).select(columns).collect())) == sorted(map(str, vs.attached(whole).select(columns).collect()))
