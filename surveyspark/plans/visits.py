"""First visits and revisits in one layout: read, keyed, weighted, checked, stacked and attached.

Records of all visits are written once, bucketed by household key.  Everything after that needs rows of one household
together, and finds them so: the key checks and the one-to-one stack group within a bucket, and attaching persons to their household joins
bucket with bucket.  None of them shuffles a row again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import weights
from surveyspark.operators import checks as ck
from surveyspark.operators import merge as mg
from surveyspark.runtime import shared_folder
from surveyspark.sources import coded

FIRST, AGAIN = "first", "revisit"
# Suffix of the columns of each file.
HOUSEHOLD_FILES = {FIRST: "hhv1", AGAIN: "hhrv"}
PERSON_FILES = {FIRST: "perv1", AGAIN: "perrv"}
# Which visits a file may hold.
VISITS = {FIRST: "V1", AGAIN: "V[2-4]"}


@dataclass(frozen=True)
class Layout:
    """The two bucketed tables; ``file`` tells where a record came from.

    ``added`` names, per table, the columns that only the revisit's file has.
    """

    households: DataFrame
    persons: DataFrame
    tables: tuple[str, str]
    added: tuple[tuple[str, ...], tuple[str, ...]]

    def drop(self) -> None:
        """Forget the tables' names; their files stay until the shared folder is cleared."""
        for name in self.tables:
            self.households.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def read_visit_files(spark: SparkSession, data_dir: str, kind: str = "csv") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Households and persons of both files, all columns as text.

    ``hhv1``, ``hhrv``, ``perv1`` and ``perrv`` must hold their key, the sampling counts and the multiplier.
    """
    def read(files: Mapping[str, str], person: bool) -> dict[str, DataFrame]:
        out = {}
        for file, suffix in files.items():
            path = f"{data_dir.rstrip('/')}/{suffix}.{kind}"
            need = _needed(suffix, person)
            if kind == "csv":
                out[file] = coded.read_all_csv(spark, path, need)
            elif kind == "parquet":
                out[file] = coded.read_all_prepared(spark, path, need)
            else:
                raise ValueError(f"unknown file kind: {kind}")
        return out

    return read(HOUSEHOLD_FILES, False), read(PERSON_FILES, True)


def _needed(suffix: str, person: bool) -> list[str]:
    counts = ("NSS", "NSC") if person else ("nss", "nsc")
    return [f"{c}_{suffix}" for c in (*[p.prefix for p in cb.KEY_PARTS], *counts, "mult", *(["b4q1"] if person else []))]


def keyed(records: DataFrame, suffix: str, person: bool, key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> DataFrame:
    """Harmonised names, HHID (and PID), and both historical weights of one file."""
    plain = mg.drop_suffix(records, suffix)
    names = {p.prefix: p.name for p in key_parts} | {"nss": "NSS", "nsc": "NSC", "mult": "Multiplier", "b4q1": "Person_number"}
    plain = plain.withColumnsRenamed({c: n for c, n in names.items() if c in plain.columns})
    household = F.concat(*[F.col(p.name) for p in key_parts])
    out = plain.withColumn("HHID", household)
    if person:
        out = out.withColumn("PID", F.concat("HHID", "Person_number"))
    return out.withColumns({"weight": weights.historical_weight(), "weight_plain": weights.unconditional_weight()})


def lay_out_level(level: str, files: Mapping[str, DataFrame], columns: Sequence[str] | None = None, buckets: int | None = None,
                  key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> tuple[DataFrame, str, tuple[str, ...]]:
    """One level (``households`` or ``persons``) of all visits, written bucketed by HHID; the table's name; columns that only revisits have.

    Besides HHID, PID and ``file`` only ``columns`` are written, if they are given: rows are wide, so name those that are wanted.
    A column that one file lacks is NULL in its records.  Records without a whole key are kept for the checks.
    """
    spark = next(iter(files.values())).sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = HOUSEHOLD_FILES if level == "households" else PERSON_FILES
    parts = {file: keyed(records, suffixes[file], level == "persons", key_parts).withColumn("file", F.lit(file)) for file, records in files.items()}
    if columns is not None:
        kept = {"HHID", "PID", "file", *columns}
        parts = {file: records.select(*[c for c in records.columns if c in kept]) for file, records in parts.items()}
    records = parts[FIRST].unionByName(parts[AGAIN], allowMissingColumns=True)
    name = f"visits_{level}_{uuid.uuid4().hex}"
    (records.repartition(buckets, "HHID").write.bucketBy(buckets, "HHID").sortBy("HHID")
     .option("path", f"{shared_folder(spark).rstrip('/')}/surveyspark-tables/{name}").saveAsTable(name))
    return spark.table(name), name, tuple(c for c in parts[AGAIN].columns if c not in parts[FIRST].columns)


def lay_out(households: Mapping[str, DataFrame], persons: Mapping[str, DataFrame], buckets: int | None = None,
            key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS, columns: Sequence[str] | None = None) -> Layout:
    """Both levels of all visits, written bucketed by HHID: the only shuffle of this workflow.  See :func:`lay_out_level`."""
    made = [lay_out_level(level, files, columns, buckets, key_parts) for level, files in (("households", households), ("persons", persons))]
    return Layout(*(m[0] for m in made), tuple(m[1] for m in made), tuple(m[2] for m in made))


# --- checks ------------------------------------------------------------------------------------------

def part_checks(key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS, person: bool = False) -> list[ck.Check]:
    """Key parts of their width and domain; the visits a file may hold depend on the file."""
    out = []
    for p in key_parts:
        domain = F.col(p.name).rlike(f"^(?:{p.pattern})$")
        if p.prefix == "visit":
            domain = F.when(F.col("file") == FIRST, F.col(p.name).rlike(f"^(?:{VISITS[FIRST]})$")).otherwise(
                F.col(p.name).rlike(f"^(?:{VISITS[AGAIN]})$"))
        out.append(ck.Check(p.name, (F.length(p.name) == p.width) & domain))
    return out + ([ck.Check("Person_number", F.col("Person_number").rlike("^[0-9]{2}$"))] if person else [])


def key_report(records: DataFrame, key: Sequence[str], key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> DataFrame:
    """``(file, check, violations)`` of one level: key parts, missing keys, repeated keys, keys that both files hold.

    ``key`` starts with HHID, so counting keys stays within buckets.
    """
    person = "Person_number" in records.columns
    checks = part_checks(key_parts, person)
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    keys = records.groupBy("file", *key).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c.broken).alias(f"c{i}") for i, c in enumerate(checks)])
    name = key[-1]
    counted = keys.groupBy("file").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(checks))],
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("missing"),
        F.count_if((F.col("rows") > 1) & ~missing).alias("repeated"))
    found = [F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(checks)]
    found += [F.struct(F.lit(f"{name} missing").alias("check"), F.col("missing").alias("violations")),
              F.struct(F.lit(f"{name} repeated").alias("check"), F.col("repeated").alias("violations"))]
    both = keys.filter(~missing).groupBy(*key).agg(F.countDistinct("file").alias("files")).agg(F.count_if(F.col("files") > 1).alias("violations"))
    return counted.select("file", F.inline(F.array(*found))).unionByName(
        both.select(F.lit("both").alias("file"), F.lit(f"{name} in both files").alias("check"), "violations"))


def repeated_records(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """All records whose key stands more than once in their file, with the number of times."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*key, "file"))
    return records.filter(F.col(key[-1]).isNotNull()).withColumn("times", times).filter("times > 1")


def enforce(layout: Layout, key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> None:
    """Stop on broken key parts, missing or repeated keys; keys in both files are no error, the merge joins them."""
    failed = []
    for records, key in ((layout.households, ["HHID"]), (layout.persons, ["HHID", "PID"])):
        rows = key_report(records, key, key_parts).filter((F.col("violations") > 0) & (F.col("file") != "both")).collect()
        failed += [f"{r['file']} {r['check']}: {r['violations']:,}" for r in rows]
    if failed:
        raise ck.CheckFailed("; ".join(sorted(failed)))


# --- merges ------------------------------------------------------------------------------------------

def stacked(records: DataFrame, key: Sequence[str], added: Sequence[str] = ()) -> DataFrame:
    """One-to-one merge of the first visit with the revisits, with ``_merge``.

    A key that both files hold gives one row: values of the first visit, even NULL ones, and the revisit's in the columns
    ``added`` that only its file has.  As the key contains the visit, sound files only stack.  Records without a whole key stay apart.
    """
    window = Window.partitionBy(*key)
    first, again = F.col("file") == FIRST, F.col("file") == AGAIN
    whole = F.col(key[-1]).isNotNull()
    filled = {c: F.coalesce(F.col(c), F.max(F.when(again & whole, F.col(c))).over(window)) for c in added}
    marked = records.withColumns({"_first": whole & F.max(first).over(window), "_again": whole & F.max(again).over(window), **filled})
    outcome = F.when(F.col("_first") & F.col("_again"), mg.BOTH).when(first, mg.LEFT_ONLY).otherwise(mg.RIGHT_ONLY)
    return marked.filter(first | ~F.col("_first")).withColumn("_merge", outcome).drop("_first", "_again", "file")


def attached(layout: Layout) -> DataFrame:
    """Persons of all visits with their household's columns, and ``_merge``; shared columns keep the household's value.

    Households and persons meet bucket by bucket.  Households without persons and persons without household stay.
    """
    households = stacked(layout.households, ["HHID"], layout.added[0]).drop("_merge")
    persons = stacked(layout.persons, ["HHID", "PID"], layout.added[1]).drop("_merge")
    return mg.merge_tables(households, persons, ["HHID"], "1:m")


def merged_visits(spark: SparkSession, data_dir: str, kind: str = "csv", buckets: int | None = None) -> DataFrame:
    """The whole workflow from files: read, key, weigh, lay out, check, stack and attach."""
    layout = lay_out(*read_visit_files(spark, data_dir, kind), buckets)
    enforce(layout)
    return attached(layout)
