"""Comparison of computed cells with published ones, and extraction of numbers from page texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark import codebook as cb
from surveyspark.operators.checks import CheckFailed

CELL_KEY = ("sheet", "Age_group", "Sector", "group_label", "code", "gender")
_NUMBER = r"\d+\.\d+"


def fixed_text(value: str, decimals: str) -> Column:
    """A number with a fixed count of decimals, as text without thousands marks."""
    return F.replace(F.expr(f"format_number(`{value}`, CAST(`{decimals}` AS INT))"), F.lit(","), F.lit(""))


def compare_cells(cells: DataFrame, published: DataFrame, key: Sequence[str] = CELL_KEY) -> DataFrame:
    """Every published cell with its computed value, how many cells it found, and two verdicts.

    ``matches`` compares text at the printed precision; ``within`` allows half a printed unit.  A key
    column that is NULL on both sides (no heading group) counts as equal.
    """
    keys = list(key)
    found = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("match_count"), F.max("value").alias("value"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = published.alias("p").join(found.alias("c"), same, "left")
    out = joined.select("p.*", F.coalesce("c.match_count", F.lit(0)).alias("match_count"), "c.value")
    return out.withColumns({
        "matches": F.coalesce(fixed_text("value", "decimals") == F.col("printed"), F.lit(False)),
        "within": F.coalesce(
            F.abs(F.col("value") - F.col("printed").cast("double")) < 0.5 * F.pow(F.lit(10.0), -F.col("decimals")),
            F.lit(False)),
    })


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Cells checked, matched, and not found exactly once."""
    return compared.agg(
        F.count(F.lit(1)).alias("cells_checked"), F.count_if("matches").alias("cells_matched"),
        F.count_if(F.col("match_count") != 1).alias("cells_not_found_once"))


def require_match(summary: DataFrame) -> None:
    """Fail a run whose comparison found differences; call it after the outputs are saved."""
    checked, matched, lost = summary.first()
    if lost:
        raise CheckFailed(f"{lost:,} published cells do not meet exactly one computed cell")
    if checked != matched:
        raise CheckFailed(f"{checked - matched:,} of {checked:,} published cells differ")


def _numbers(line: str) -> Column:
    return F.regexp_extract_all(F.col(line), F.lit(f"({_NUMBER})"), F.lit(1))


# Fixed values below: how the published pages print their lines.

def division_rows(pages: DataFrame, keys: Sequence[str] = ("page_no",)) -> DataFrame:
    """``Division d`` lines with nine numbers, one output row per number.

    Positions run over sector and, within it, gender.
    """
    row = r"(?m)^(\s*Division\s+[1-9](?:\s+" + _NUMBER + r"){9})"
    lines = pages.select(*keys, F.explode(F.regexp_extract_all(F.col("text"), F.lit(row), F.lit(1))).alias("line"))
    lines = lines.withColumn("code", F.regexp_extract("line", r"Division\s+([1-9])", 1))
    cells = lines.select(*keys, "code", F.posexplode(_numbers("line")).alias("position", "printed"))
    return cells.withColumns({
        "Sector": _nth([s for s in (*cb.SECTORS, cb.POOLED_SECTOR) for _ in cb.GENDERS], "position"),
        "gender": _nth([g for _ in range(3) for g in cb.GENDERS], "position"),
    }).select(*keys, "code", "Sector", "gender", "printed")


def group_rows(pages: DataFrame, keys: Sequence[str] = ("page_no",),
               headings: Mapping[str, str] = cb.PUBLISHED_GROUP_HEADINGS) -> DataFrame:
    """Status shares under ``social group:`` headings: sector, gender and six numbers per line."""
    blocks = pages.select(*keys, F.posexplode(F.split("text", r"(?i)social group:")).alias("block", "body"))
    blocks = blocks.filter("block > 0")  # what precedes the first heading belongs to no group
    group = F.lit(None).cast("string")
    for heading, label in headings.items():
        group = F.when(F.col("body").rlike(r"(?i)^\s*" + heading), label).otherwise(group)
    row = (r"(?m)^(\s*(?:rural\s*\+\s*urban|rural|urban)\s+(?:male|female|person)(?:\s+" + _NUMBER + r"){6})")
    lines = blocks.withColumn("group_label", group).filter(F.col("group_label").isNotNull()).select(
        *keys, "block", "group_label", F.explode(F.regexp_extract_all(F.col("body"), F.lit(row), F.lit(1))).alias("line"))
    lines = lines.withColumns({
        "Sector": F.when(F.col("line").contains("+"), cb.POOLED_SECTOR)
        .otherwise(F.initcap(F.regexp_extract("line", r"(rural|urban)", 1))),
        "gender": F.initcap(F.replace(F.regexp_extract("line", r"(female|male|person)", 1), F.lit("person"), F.lit("persons"))),
    })
    cells = lines.select(*keys, "group_label", "Sector", "gender", F.posexplode(_numbers("line")).alias("position", "printed"))
    return cells.withColumn("code", _nth(cb.STATUS_COLUMNS, "position")).select(
        *keys, "group_label", "Sector", "gender", "code", "printed")


# The two table commands whose layout is known, and the lines printed under them.
STATUS_COMMAND, DIVISION_COMMAND = r"^tab\s+Gender\s+Broad_Status", r"^tab\s+NCO_Divison\s+Gender"
STATUS_LINE = r"(?m)^(\s*(?:Male|Female|Total)(?:\s+" + _NUMBER + r"){4}\s+100\.00)"
DIVISION_LINE = r"(?m)^(\s*[1-9](?:\s+" + _NUMBER + r"){3}\s*)$"
STATUS_LINES, DIVISION_LINES = 3, 9


def _log_parts(pages: DataFrame, document: str, page: str) -> DataFrame:
    """Text pieces with the command that they follow; ``own`` marks the piece that holds the command itself.

    A table may continue on the next page: what precedes the first command of a page belongs to the last command before it.
    """
    command_line = r"(?m)^(\s*\d+\s*\.[^\r\n]*)"
    # Mark command lines, then cut each page in front of the marks.
    marked = F.regexp_replace("text", command_line, "\u0001$1")
    parts = pages.select(document, page, F.posexplode(F.split(marked, "\u0001")).alias("part", "body"))
    parts = parts.withColumns({
        "command": F.when(F.col("part") > 0, F.regexp_extract("body", r"^\s*\d+\s*\.\s*([^\r\n]*)", 1)),
        "rest": F.when(F.col("part") > 0, F.regexp_replace("body", r"^\s*\d+\s*\.[^\r\n]*", "")).otherwise(F.col("body")),
    })
    # One short row per page decides what its head continues.
    last = parts.filter("part > 0").groupBy(document, page).agg(
        F.max_by(F.struct("command", "part"), F.col("part")).alias("last"))
    every = pages.select(document, page).distinct().join(last, [document, page], "left")
    before = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(document, page, F.last("last", ignorenulls=True).over(before).alias("carried"),
                           F.last(F.when(F.col("last").isNotNull(), F.col(page)), ignorenulls=True)
                           .over(before).alias("carried_page"))
    return parts.join(carried, [document, page], "left").select(
        document,
        F.when(F.col("part") > 0, F.col(page)).otherwise(F.col("carried_page")).alias("command_page"),
        F.when(F.col("part") > 0, F.col("part")).otherwise(F.col("carried.part")).alias("command_part"),
        F.coalesce("command", "carried.command").alias("command"), "rest", (F.col("part") > 0).alias("own"))


def log_commands(pages: DataFrame, document: str = "document", page: str = "page_no") -> DataFrame:
    """One row for each supported table command of a results log: what its table shows, and how far it could be read.

    Sector, age and group come from the command.  ``lines`` are the table lines read and ``expected`` those its layout has;
    ``readable`` also needs known codes in the command.  ``cells`` holds what was read, so a lost table is a row that says so.
    """
    parts = _log_parts(pages, document, page)
    is_status = F.col("command").rlike(STATUS_COMMAND)
    parts = parts.filter(is_status | F.col("command").rlike(DIVISION_COMMAND)).withColumn("is_status", is_status)
    pattern = F.when(F.col("is_status"), F.lit(STATUS_LINE)).otherwise(F.lit(DIVISION_LINE))
    # A table has a handful of lines, on few pages.
    tables = parts.withColumn("found", F.regexp_extract_all("rest", pattern, F.lit(1))).groupBy(
        document, "command_page", "command_part", "command", "is_status").agg(F.flatten(F.collect_list("found")).alias("found"))
    sector = F.regexp_extract("command", r"Sector\s*==\s*(\d+)", 1)
    known = F.lit(True)
    sheet, group = F.lit("employment_status"), F.lit(None).cast("string")
    for column, (written, target) in {"Social_group": ("Social_Group", "employment_social_group"),
                                      "Religion": ("Religion", "employment_religion")}.items():
        code = F.regexp_extract("command", written + r"\s*==\s*(\d+)", 1)
        labels = F.create_map(*[F.lit(v) for pair in cb.LABELS[column].items() for v in pair])
        sheet = F.when(code != "", F.lit(target)).otherwise(sheet)
        group = F.when(code != "", F.try_element_at(labels, code)).otherwise(group)
        known = known & ((code == "") | ~F.col("is_status") | F.try_element_at(labels, code).isNotNull())
    expected = F.when(F.col("is_status"), STATUS_LINES).otherwise(DIVISION_LINES)
    names = F.transform("found", lambda line: F.regexp_extract(line, r"^\s*(\w+)", 1))
    return tables.select(
        document, "command_page", "command_part", "command", "is_status",
        F.when(F.col("is_status"), sheet).otherwise("NCO_division").alias("sheet"),
        F.when(F.col("command").rlike(r"Age\s*>=\s*15"), "15+").otherwise("All ages").alias("Age_group"),
        F.when(sector == "1", "Rural").when(sector == "2", "Urban").otherwise(cb.POOLED_SECTOR).alias("Sector"),
        F.when(F.col("is_status"), group).alias("group_label"),
        F.size("found").alias("lines"), expected.alias("expected"),
        (known & sector.isin("", "1", "2") & (F.size("found") == expected) & (F.size(F.array_distinct(names)) == expected)).alias("readable"),
        "found")


def log_cells(commands: DataFrame, document: str = "document") -> DataFrame:
    """Every cell that the commands of :func:`log_commands` should have printed; ``printed`` is NULL where it was not read."""
    heads = [document, "command_page", "command_part", "command", "is_status", "sheet", "Age_group", "Sector", "group_label"]
    row_name = F.array(*map(F.lit, ("Male", "Female", "Total")))
    rows = commands.select(*heads, "found", F.explode(F.when(F.col("is_status"), row_name).otherwise(
        F.array(*[F.lit(str(d)) for d in range(1, DIVISION_LINES + 1)]))).alias("row"))
    line = F.get(F.filter("found", lambda x: F.regexp_extract(x, r"^\s*(\w+)", 1) == F.col("row")), F.lit(0))
    # The closing 100.00 of a status line is no cell.
    cells = rows.withColumn("numbers", F.regexp_extract_all(line, F.lit(f"({_NUMBER})"), F.lit(1))).select(
        *heads, "row", "numbers", F.explode(F.sequence(F.lit(0), F.when(F.col("is_status"), 3).otherwise(2))).alias("position"))
    return cells.select(
        *heads[:4], "is_status", "sheet", "Age_group", "Sector", "group_label",
        F.when(F.col("is_status"), _nth(("1", "2", "3", "4"), "position")).otherwise(F.col("row")).alias("code"),
        F.when(F.col("is_status"), F.when(F.col("row") == "Total", "Persons").otherwise(F.col("row")))
        .otherwise(_nth(cb.GENDERS, "position")).alias("gender"),
        F.get("numbers", F.col("position")).alias("printed"), F.lit(2).alias("decimals"))


def log_rows(pages: DataFrame, document: str = "document", page: str = "page_no") -> DataFrame:
    """Cells that could be read of the tables printed in a results log."""
    cells = log_cells(log_commands(pages, document, page), document)
    return cells.filter(F.col("printed").isNotNull()).drop("is_status")


def require_readable(commands: DataFrame) -> None:
    """Stop if a log holds no supported command, or one whose table could not be read in full."""
    total, lost, example = commands.agg(
        F.count(F.lit(1)), F.count_if(~F.col("readable")), F.min(F.when(~F.col("readable"), F.col("command")))).first()
    if not total:
        raise CheckFailed("the log holds no table command of a known layout")
    if lost:
        raise CheckFailed(f"{lost:,} of {total:,} logged tables could not be read, for example: {example}")


def expect_rows(cells: DataFrame, block: Sequence[str], expected: int) -> DataFrame:
    """Blocks whose number of extracted cells differs from the layout's, as a check report."""
    sizes = cells.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") != expected).alias("violations")).select(
        F.lit(f"{expected} cells per block").alias("check"), "violations")


def annual_published(occupation_pages: DataFrame, group_pages: DataFrame) -> DataFrame:
    """Published cells of the two annual page layouts, keyed like report cells."""
    divisions = division_rows(occupation_pages).select(
        F.lit("NCO_division").alias("sheet"), F.lit("All ages").alias("Age_group"), "Sector",
        F.lit(None).cast("string").alias("group_label"), "code", "gender", "printed", F.lit(2).alias("decimals"))
    groups = group_rows(group_pages).select(
        F.lit("employment_social_group").alias("sheet"), F.lit("All ages").alias("Age_group"), "Sector", "group_label",
        "code", "gender", "printed", F.lit(1).alias("decimals"))
    return divisions.unionByName(groups)


def _nth(values: Sequence[str], position: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(position))
