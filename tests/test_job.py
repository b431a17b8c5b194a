import pytest
from pyspark.errors import PySparkException

from surveyspark.plans import catalogue as ct
from surveyspark.plans import job
from surveyspark.plans import workflow as wf
from tests import invented


def test_option_rules():
    for arguments in (["--data-dir", "x", "--check-only", "--verify", "--reference-pages", "p"],
                      ["--data-dir", "x", "--check-only", "--save-merged"],
                      ["--data-dir", "x", "--output-dir", "o", "--reference-pages", "p"],
                      ["--data-dir", "x"], ["--data-dir", "x", "--output-dir", "o", "--mode", "weekly"]):
        with pytest.raises(SystemExit):
            job.parse(arguments)


def test_whole_job(spark, tmp_path):
    invented.write_csv(tmp_path)
    out = tmp_path / "out"
    assert job.main(["--data-dir", str(tmp_path), "--output-dir", str(out), "--save-merged"]) == 0
    cells = spark.read.parquet(str(out / "report_cells"))
    assert cells.select("sheet").distinct().count() == 31
    audit = spark.read.json(str(out / "merge_audit")).first()
    assert audit["persons_used"] == 28 and audit["mode"] == "annual"
    assert spark.read.option("header", True).csv(str(out / "table_guide")).count() == 31
    notes = {(r["Topic"], r["Name"]): r["Definition"] for r in spark.read.option("header", True).csv(str(out / "notes")).collect()}
    assert notes["age group", "15-29"] == "15 to 29" and "Worker" in notes["population", "Workers"] and notes["band", "NIC_three 6"] == "5 to 43"
    assert spark.read.parquet(str(out / "merged_first_visit")).count() == 28
    assert job.main(["--data-dir", str(tmp_path), "--check-only"]) == 0
    assert job.main(["--data-dir", str(tmp_path / "nowhere"), "--check-only"]) == 1


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    """Finished tables of a run that was cut short are used again, and nothing is left in its folder at the end."""
    invented.write_csv(tmp_path)
    folder = tmp_path / "run"
    command = ["--data-dir", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--run-folder", str(folder)]

    def dies(*_):
        raise PySparkException("an executor was lost once too often")

    with monkeypatch.context() as change:
        change.setattr(job.ct, "report_cells", dies)
        assert job.main(command) == 1
    assert {p.name for p in folder.glob("*.done")} == {"persons.done", "households.done", "merged.done", "prepared.done"}
    with monkeypatch.context() as change:
        change.setattr(job.wf, "merge_files", dies)
        assert job.main(command) == 0, "the merge is not made again"
    assert not folder.exists()
    assert spark.read.parquet(str(tmp_path / "out" / "report_cells")).select("sheet").distinct().count() == 31


def test_mismatch_fails_after_saving(spark, tmp_path):
    invented.write_csv(tmp_path)
    line = " 2 . tab NCO_Divison Gender [iw=weight] if Age>=15, nof col\n"
    prepared = wf.prepared(*invented.frames(spark), mode="video")
    spec = [s for s in ct.CATALOGUE if s.sheet == "NCO_division"]
    shares = {(r["code"], r["gender"]): r["value"] for r in ct.report_cells(prepared, spec).filter(
        "Age_group = '15+' and Sector = 'Rural + Urban'").collect()}
    text = line + "\n".join(f"  {d}  " + "  ".join(f"{shares[str(d), g]:.2f}" for g in ("Male", "Female", "Persons"))
                            for d in range(1, 10))

    def run(content, out):
        pages = str(tmp_path / f"pages-{out}")
        spark.createDataFrame([(1, content)], "page_no int, text string").write.parquet(pages)
        return job.main(["--data-dir", str(tmp_path), "--mode", "video", "--output-dir", str(tmp_path / out),
                         "--verify", "--reference-pages", pages])

    assert run(text, "good") == 0
    audit = spark.read.json(str(tmp_path / "good" / "merge_audit")).first()
    assert audit["cells_checked"] == audit["cells_matched"] == 27
    wrong = text.replace(f"{shares['1', 'Male']:.2f}", "99.99", 1)
    assert run(wrong, "bad") == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "bad" / "comparison")).count() == 27


def test_microdata_is_written_by_methods_that_the_jvm_compiles(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from surveyspark.sources import sinks

    key, seen, write = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(key))), write(self, *a, **k)))
    before = spark.conf.get(key)
    sinks.write_microdata(spark.range(3), str(tmp_path / "rows"))
    assert seen == [8000] and spark.conf.get(key) == before and spark.read.parquet(str(tmp_path / "rows")).count() == 3
