"""From two coded files to the prepared person table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import recode, status, weights
from surveyspark.operators import checks as ck
from surveyspark.operators import merge as mg
from surveyspark.runtime import RunFolder, observed, small_table

MODES = ("annual", "video")


@dataclass(frozen=True)
class FirstVisits:
    """Analysis rows and what is needed to audit them."""

    data: DataFrame
    audit: DataFrame


def key_files(persons: DataFrame, households: DataFrame,
              key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> tuple[DataFrame, DataFrame]:
    """Add ``HHID`` to both files and ``PID`` to persons."""
    persons = persons.withColumn("HHID", mg.composite_key("perv1", key_parts))
    persons = persons.withColumn("PID", F.concat("HHID", "b4q1_perv1"))
    households = households.withColumn("HHID", mg.composite_key("hhv1", key_parts))
    return persons, households


@dataclass(frozen=True)
class Landed:
    """Both keyed files as written tables, with what the writes counted."""

    persons: DataFrame
    households: DataFrame
    person_facts: dict[str, int]
    household_facts: dict[str, int]

    def key_reports(self) -> list[DataFrame]:
        return [ck.key_report(self.households, ["HHID"]), ck.key_report(self.persons, ["PID"])]


def land(persons: DataFrame, households: DataFrame, run: RunFolder, key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS,
         keys_only: bool = False) -> Landed:
    """Read each file once: key it, write it, and count its rows and broken key parts on the way.

    With ``keys_only`` the tables hold the keys and nothing else, which is all that the file checks read again.
    """
    persons, households = key_files(persons, households, key_parts)

    def counted(df: DataFrame, checks: list[ck.Check]):
        df, observation = observed(df, {"rows": F.count(F.lit(1)), **ck.counters(checks)})
        return df.select(*[c for c in ("HHID", "PID") if c in df.columns]) if keys_only else df, [observation]

    persons, person_facts = run.table("persons", lambda: counted(
        persons, ck.key_part_checks("perv1", key_parts) + [ck.serial_check("b4q1_perv1")]))
    households, household_facts = run.table("households", lambda: counted(households, ck.key_part_checks("hhv1", key_parts)))
    return Landed(persons, households, person_facts, household_facts)


def file_report(landed: Landed) -> DataFrame:
    """``(check, violations)`` of both files before they are merged."""
    parts = [(name, n) for facts in (landed.person_facts, landed.household_facts) for name, n in facts.items() if name != "rows"]
    out = small_table(landed.persons.sparkSession, parts, "check string, violations bigint")
    for report in landed.key_reports():
        out = out.unionByName(report)
    return out


def merge_files(persons: DataFrame, households: DataFrame) -> DataFrame:
    """Every person with the household's columns, and ``_merge``."""
    return mg.merge_tables(persons, households, ["HHID"], "m:1")


def agreement_pairs(key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> list[tuple[str, str]]:
    return [(f"{p.prefix}_perv1", f"{p.prefix}_hhv1") for p in key_parts] + list(cb.AGREEMENT_FIELDS)


def analysis_columns(merged: DataFrame, key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> DataFrame:
    """Matched rows under their analysis names, numbers cast strictly."""
    names = {f"{p.prefix}_perv1": p.name for p in key_parts}
    names |= cb.PERSON_FIELDS | cb.HOUSEHOLD_FIELDS
    names |= {c: n for c, n in cb.WAGE_FIELDS.items() if c in merged.columns}
    matched = merged.filter(F.col("_merge") == mg.BOTH).select("HHID", "PID", *names).withColumnsRenamed(names)
    kinds = {c: "int" if c.endswith("_status") else "double" for c in cb.NUMERIC_FIELDS}
    kinds |= {n: "double" for n in cb.WAGE_FIELDS.values() if n in matched.columns}
    return matched.withColumns({c: recode.strict_number(c, k) for c, k in kinds.items()})


def apply_mode(data: DataFrame, mode: str = "annual") -> DataFrame:
    """Weights and report gender; the historical mode also drops gender code 3."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    data = data.withColumns({
        "Annual_weight": weights.annual_weight(),
        "Gender_code": status.report_gender_code(),
    }).withColumn("Weight", F.col("Annual_weight"))
    if mode == "video":
        data = data.withColumn("Weight", weights.historical_weight())
        data = data.filter(F.col("Gender_original").isin("1", "2"))
    return data


def derive_categories(data: DataFrame) -> DataFrame:
    """Activity flags, the selected job and every table category."""
    data = data.withColumns({"Gender": status.gender_name(F.col("Gender_code")), **status.activity_flags()})
    data = data.withColumns({
        "Status_used": status.selected_job("Principal_status", "Subsidiary_status"),
        "NIC": status.selected_job("NIC_principal", "NIC_subsidiary"),
        "NCO": status.selected_job("NCO_principal", "NCO_subsidiary"),
        "Social_security": status.selected_job("Security_principal", "Security_subsidiary"),
        "Economic_months": status.selected_job("Economic_months_principal", "Economic_months_subsidiary"),
    })
    data = data.withColumns({
        "Broad_status": status.broad_status("Status_used"),
        "NIC_division": recode.code_prefix("NIC", 2),
        "NCO_division": recode.code_prefix("NCO", 1),
        "NCO_subdivision": recode.code_prefix("NCO", 2),
        "Attendance_group": recode.band_code("Attendance_code", cb.ATTENDANCE_BANDS),
        "Household_spending_band": recode.bin_code("Household_monthly_spending", cb.SPENDING_UPPER_BOUNDS),
    })
    return data.withColumns({
        "NIC_broad": recode.band_code("NIC_division", cb.NIC_BROAD_BANDS),
        "NIC_three": recode.band_code("NIC_division", cb.NIC_THREE_BANDS),
    })


def analysis_checks() -> list[ck.Check]:
    """Checks on the renamed rows, before weights are used."""
    return ck.weight_checks() + ck.person_checks()


def prepared_checks(teaching: bool = False) -> list[ck.Check]:
    """Checks on the prepared rows; ``teaching`` adds the stricter walkthrough rules."""
    out = [*ck.activity_checks(), *ck.selected_job_checks(), *ck.flag_checks(), ck.final_weight_check()]
    if teaching:
        out += [*ck.household_code_checks(), *ck.benefit_checks(), *ck.recode_checks()]
    return out


def _used(mode: str) -> Column:
    """Rows that a mode keeps."""
    return F.col("Gender_original").isin("1", "2") if mode == "video" else F.lit(True)


def _final_weight(mode: str) -> Column:
    return weights.historical_weight() if mode == "video" else weights.annual_weight()


def merge_metrics(key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> dict[str, Column]:
    """Outcomes of the merge, and matched rows whose files disagree."""
    both = F.col("_merge") == mg.BOTH
    out = {"persons_before_filter": F.count_if(F.col("_merge") != mg.RIGHT_ONLY), "matched_persons": F.count_if(both),
           "persons_without_household": F.count_if(F.col("_merge") == mg.LEFT_ONLY),
           "households_without_persons": F.count_if(F.col("_merge") == mg.RIGHT_ONLY)}
    checks = [ck.Check(f"{a} = {b}", F.col(a) == F.col(b)) for a, b in agreement_pairs(key_parts)]
    return out | ck.counters(checks)


def row_metrics(mode: str) -> dict[str, Column]:
    """Counts of the analysis rows, and their broken checks."""
    return {"gender_code_3_records": F.count_if(F.col("Gender_original") == "3"),
            "persons_with_fewer_than_four_quarters": F.count_if(F.col("Contributing_quarters") < 4),
            "persons_used": F.count_if(_used(mode)), "sum_of_weights": F.sum(F.when(_used(mode), _final_weight(mode))),
            **ck.counters(analysis_checks())}


AUDIT = ("households", "persons_before_filter", "matched_persons", "persons_without_household", "households_without_persons",
         "gender_code_3_records", "persons_with_fewer_than_four_quarters", "persons_used", "sum_of_weights")


def audit_table(spark: SparkSession, facts: dict, mode: str, source: str) -> DataFrame:
    """One row of run counts, all of them observed during the writes."""
    kinds = ", ".join(f"{name} {'double' if name == 'sum_of_weights' else 'bigint'}" for name in AUDIT)
    return small_table(spark, [(mode, source, *[facts[name] for name in AUDIT])], f"mode string, input_directory string, {kinds}")


def refuse_merge(facts: dict, key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> None:
    """Stop on unmatched rows of either file, then on columns that disagree."""
    alone, empty = facts["persons_without_household"], facts["households_without_persons"]
    if alone or empty:
        raise ck.CheckFailed(f"merge stopped: {alone:,} persons have no household; {empty:,} households have no persons")
    ck.refuse({name: facts[name] for name in (f"{a} = {b}" for a, b in agreement_pairs(key_parts))})


def first_visits(persons: DataFrame, households: DataFrame, mode: str = "annual", source: str = "",
                 key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS, strict: bool = True, run: RunFolder | None = None) -> FirstVisits:
    """Keyed, merged, checked and weighted person rows.

    In strict mode each file is read once, into a landing table, and the merge is written once; every check but the uniqueness of keys, and
    the whole audit, is counted during these writes.  File checks are reported together, then the merge, then the row checks; nothing is
    returned unless they hold.  Otherwise the rows are one lazy plan, and only the audit is counted.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not strict:
        return _audited(persons, households, mode, source, key_parts)
    run = run or RunFolder(persons.sparkSession)
    landed = land(persons, households, run, key_parts)
    broken = {n: v for facts in (landed.person_facts, landed.household_facts) for n, v in facts.items() if n != "rows"}
    for report in landed.key_reports():
        broken |= {r["check"]: r["violations"] for r in report.collect()}
    ck.refuse(broken)

    def merge():
        merged, outcomes = observed(merge_files(landed.persons, landed.households), merge_metrics(key_parts))
        rows, counts = observed(analysis_columns(merged, key_parts), row_metrics(mode))
        return rows, [outcomes, counts]

    data, facts = run.table("merged", merge)
    refuse_merge(facts, key_parts)
    ck.refuse({c.name: facts[c.name] for c in analysis_checks()})
    facts["households"] = landed.household_facts["rows"]
    return FirstVisits(apply_mode(data, mode), audit_table(persons.sparkSession, facts, mode, source))


def _audited(persons: DataFrame, households: DataFrame, mode: str, source: str, key_parts: Sequence[cb.KeyPart]) -> FirstVisits:
    """The rows as one lazy plan and their audit, observed in one pass that reads only the columns it counts."""
    persons, households = key_files(persons, households, key_parts)

    def audited(metrics: dict[str, Column]) -> dict[str, Column]:
        return {n: c for n, c in metrics.items() if n in AUDIT}

    merged = merge_files(persons, households)
    watched, outcomes = observed(merged, audited(merge_metrics(key_parts)))
    rows, counts = observed(analysis_columns(watched, key_parts), audited(row_metrics(mode)))
    rows.select(F.lit(1).alias("one")).write.format("noop").mode("overwrite").save()
    facts = {**outcomes.get, **counts.get, "households": households.count()}
    return FirstVisits(apply_mode(analysis_columns(merged, key_parts), mode), audit_table(persons.sparkSession, facts, mode, source))


def prepared(persons: DataFrame, households: DataFrame, mode: str = "annual",
             key_parts: Sequence[cb.KeyPart] = cb.KEY_PARTS) -> DataFrame:
    """The prepared table as one lazy plan, without the stopping checks."""
    keyed_persons, keyed_households = key_files(persons, households, key_parts)
    merged = merge_files(keyed_persons, keyed_households)
    return derive_categories(apply_mode(analysis_columns(merged, key_parts), mode))
