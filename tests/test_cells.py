"""Cells of many tables, counted in the tasks that hold the rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from surveyspark.operators import cells as cl


def test_cells_match_a_row_by_row_count(spark):
    rows = [(a, x, y, p, g, c, w) for a in (0, 1, 3) for x in ("1", "2", None) for y in ("Male", None) for p in (True, None)
            for g in ("u", None) for c, w in (("10", 1.5), ("11", None), (None, 2.0), ("10", 0.25))]
    df = spark.createDataFrame(rows, "a int, Sector_code string, Gender string, p boolean, g string, c string, w double").repartition(3)
    tables = [cl.Table("some", "c", None, 1), cl.Table("all", "c", "g", 3), cl.Table("all", "g", "c", 2)]
    got = cl.cell_sums(df, tables, {"some": F.col("p"), "all": F.lit(True)}, {"c": F.col("c"), "g": F.col("g")}, F.col("a"), {"w": F.col("w")}, chunk=7)
    want = defaultdict(lambda: [0, None])
    for i, t in enumerate(tables):
        for a, x, y, p, g, c, w in rows:
            text = {"c": c, "g": g}
            if (a & t.ages) and text[t.code] is not None and (p or t.people == "all") and (t.group is None or text[t.group] is not None):
                cell = want[i, a & t.ages, x, y, t.group and text[t.group], text[t.code]]
                cell[0] += 1
                cell[1] = cell[1] if w is None else (cell[1] or 0.0) + w
    assert {tuple(r[:6]): [r["n"], r["w"]] for r in got.collect()} == dict(want)
    # No row is spelled out once for each table.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan
