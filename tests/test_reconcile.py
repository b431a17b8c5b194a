import pytest

from surveyspark.operators import reconcile as rc
from surveyspark.operators.checks import CheckFailed, enforce

NINE = "1.10 2.20 3.30 4.40 5.50 6.60 7.70 8.80 9.90"


def test_division_rows(spark):
    text = "head\nDivision  share\n" + "\n".join(f"  Division {d}  {NINE.replace(' ', '   ')}" for d in range(1, 10)) + "\nall 100.00"
    cells = rc.division_rows(spark.createDataFrame([(210, text)], "page_no int, text string")).collect()
    assert len(cells) == 81
    by = {(r["code"], r["Sector"], r["gender"]): r["printed"] for r in cells}
    assert by["3", "Rural", "Male"] == "1.10" and by["9", "Rural + Urban", "Persons"] == "9.90" and by["1", "Urban", "Male"] == "4.40"


def test_group_rows(spark):
    rows = "\n".join(f" {s}   {g}  40.1 14.2 54.3 12.4 33.3 100.0"
                     for s in ("rural", "urban", "rural + urban") for g in ("male", "female", "person"))
    text = f"intro\n rural male 9.9 9.9 9.9 9.9 9.9 9.9\nSocial Group: Scheduled Tribe\n{rows}\nsocial group: scheduled caste\n{rows}\nsocial group: all\n{rows}"
    cells = rc.group_rows(spark.createDataFrame([(393, text)], "page_no int, text string")).collect()
    assert len(cells) == 2 * 54
    by = {(r["group_label"], r["Sector"], r["gender"], r["code"]): r["printed"] for r in cells}
    assert by["ST", "Rural + Urban", "Persons", "self"] == "54.3" and by["SC", "Urban", "Female", "total"] == "100.0"


def test_log_rows_across_pages(spark):
    status = "\n".join(f"  {g}   40.10   14.20   12.40   33.30   100.00" for g in ("Male", "Female"))
    pages = [
        ("log", 1, "start\n 3 . count\n  1   1.00  2.00  3.00\n 4 . tab Gender Broad_Status [iw=weight] if Sector==1 & Age>=15 & Social_Group==9, nof row\n" + status),
        ("log", 2, "   nothing but a picture"),
        ("log", 3, "  Total   41.00   14.00   12.00   33.00   100.00\n 5 . tab NCO_Divison Gender [iw=weight], nof col\n"
         + "\n".join(f"   {d}   1.00   2.00   3.00  " for d in range(1, 10)) + "\n 6. end"),
    ]
    cells = rc.log_rows(spark.createDataFrame(pages, "document string, page_no int, text string"))
    rows = cells.collect()
    assert len(rows) == 12 + 27
    total = [r for r in rows if r["gender"] == "Persons" and r["sheet"] == "employment_social_group"]
    assert {r["code"]: r["printed"] for r in total} == {"1": "41.00", "2": "14.00", "3": "12.00", "4": "33.00"}
    assert all((r["Age_group"], r["Sector"], r["group_label"]) == ("15+", "Rural", "Others") for r in total)
    division = {(r["code"], r["gender"]): r["printed"] for r in rows if r["sheet"] == "NCO_division"}
    assert division["9", "Persons"] == "3.00" and len(division) == 27
    enforce(rc.expect_rows(cells.filter("sheet = 'NCO_division'"), ["document", "command_page", "command_part"], 27))
    with pytest.raises(CheckFailed):
        enforce(rc.expect_rows(cells, ["document", "command_page", "command_part"], 12))


def test_a_lost_table_is_a_row(spark):
    """Every supported command has its row, whether its table could be read or not."""
    whole = "\n".join(f"  {g}   40.10   14.20   12.40   33.30   100.00" for g in ("Male", "Female", "Total"))
    divisions = "\n".join(f"   {d}   1.00   2.00   3.00  " for d in range(1, 10))
    text = "\n".join([
        " 1 . tab Gender Broad_Status [iw=weight], nof row", whole,
        " 2 . tab Gender Broad_Status [iw=weight] if Sector==2, nof row", "  Male  40,10  14,20  12,40  33,30  100,00",
        " 3 . tab Gender Broad_Status [iw=weight] if Religion==99, nof row", whole,
        " 4 . tab NCO_Divison Gender [iw=weight] if Sector==7, nof col", divisions,
        " 5 . tab NCO_Divison Gender [iw=weight], nof col", divisions.replace("   9 ", "   8 "),
        " 6 . tab Gender Broad_Status [iw=weight] if Age>=15, nof row", whole.replace("Female", "Fem."),
        " 7 . count", whole])
    commands = rc.log_commands(spark.createDataFrame([("log", 1, text)], "document string, page_no int, text string"))
    got = {r["command_part"]: (r["lines"], r["expected"], r["readable"]) for r in commands.collect()}
    assert got == {1: (3, 3, True), 2: (0, 3, False), 3: (3, 3, False), 4: (9, 9, False), 5: (9, 9, False), 6: (2, 3, False)}
    cells = rc.log_cells(commands).collect()
    assert len(cells) == 4 * 12 + 2 * 27
    assert {r["command_part"]: sum(c["printed"] is None for c in cells if c["command_part"] == r["command_part"]) for r in cells} == {
        1: 0, 2: 12, 3: 0, 4: 0, 5: 3, 6: 4}
    with pytest.raises(CheckFailed, match="5 of 6 logged tables"):
        rc.require_readable(commands)
    rc.require_readable(commands.filter("command_part = 1"))
    with pytest.raises(CheckFailed, match="no table command"):
        rc.require_readable(commands.filter("command_part = 99"))


def test_comparison(spark):
    cells = spark.createDataFrame(
        [("s", "All ages", "Rural", None, "1", "Male", 2.675), ("s", "All ages", "Rural", None, "2", "Male", 12.35),
         ("s", "All ages", "Rural", "ST", "1", "Male", -0.04), ("s", "All ages", "Rural", "ST", "3", "Male", 1234.5)],
        "sheet string, Age_group string, Sector string, group_label string, code string, gender string, value double")
    published = spark.createDataFrame(
        [("s", "All ages", "Rural", None, "1", "Male", f"{2.675:.2f}", 2), ("s", "All ages", "Rural", None, "2", "Male", "12.4", 1),
         ("s", "All ages", "Rural", "ST", "1", "Male", f"{-0.04:.1f}", 1), ("s", "All ages", "Rural", "ST", "3", "Male", "1234.50", 2),
         ("s", "All ages", "Urban", None, "1", "Male", "1.0", 1)],
        "sheet string, Age_group string, Sector string, group_label string, code string, gender string, printed string, decimals int")
    compared = rc.compare_cells(cells, published)
    rows = {(r["Sector"], r["group_label"], r["code"]): (r["match_count"], r["matches"]) for r in compared.collect()}
    assert rows["Rural", None, "1"] == (1, True) and rows["Rural", "ST", "1"] == (1, True) and rows["Rural", "ST", "3"] == (1, True)
    assert rows["Rural", None, "2"] == (1, f"{12.35:.1f}" == "12.4") and rows["Urban", None, "1"] == (0, False)
    with pytest.raises(CheckFailed, match="exactly one"):
        rc.require_match(rc.comparison_summary(compared))
    with pytest.raises(CheckFailed, match="not|differ|exactly"):
        rc.require_match(rc.comparison_summary(compared.filter("match_count = 1").withColumn("matches", compared["code"] == "9")))
