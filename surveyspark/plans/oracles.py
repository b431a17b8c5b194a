"""The same results as plain SQL for an independent engine, one statement per query.

Only the derivation of the inputs (the survey-shaped views) shares its expressions with the Spark
side.  Codes, weights, flags, tables, percentiles and models are written out here again.
"""

from __future__ import annotations

from surveyspark import codebook as cb
from surveyspark.plans import adapters as ad
from surveyspark.plans import catalogue as ct

ORACLES: dict[str, str] = {}


def R(expression: str, places: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0.0e0)"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def _values(rows) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


# --- shared inputs -------------------------------------------------------------------------------

_FILES = f"""
persons AS (SELECT {_select(ad.PERSON)} FROM (SELECT *, {_select(ad.PERSON_STAGE)} FROM ({ad.PERSON_BASE})) b JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey),
all_households AS (SELECT {_select(ad.HOUSEHOLD)}, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
households AS (SELECT * EXCLUDE (o_orderkey) FROM all_households WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
"""


def _hhid(suffix: str) -> str:
    return " || ".join(f"{p.prefix}_{suffix}" for p in ad.KEY_PARTS)


_WORK = "(11, 12, 21, 31, 41, 51)"


def _band_case(value: str, bands, otherwise: str) -> str:
    whens = " ".join(f"WHEN CAST({value} AS INT) BETWEEN {b.lower} AND {b.upper} THEN '{b.code}'" for b in bands)
    return f"CASE {whens} ELSE {otherwise} END"


def _chosen(principal: str, subsidiary: str) -> str:
    return (f"CASE WHEN Principal_status IN {_WORK} THEN {principal} "
            f"WHEN coalesce(Subsidiary_status IN {_WORK}, FALSE) THEN {subsidiary} END")


def _prepared(mode: str = "annual") -> str:
    quarter = "CAST(mult_perv1 AS DOUBLE) / CASE WHEN NSS_perv1 = NSC_perv1 THEN 100.0e0 ELSE 200.0e0 END"
    weight = f"{quarter} / CAST(no_qtr_perv1 AS DOUBLE)"
    keep = ""
    if mode == "video":
        weight, keep = f"CAST(CAST({quarter} AS FLOAT) AS DOUBLE)", "AND b4q5_perv1 IN ('1', '2')"
    spending = "CAST(b3q5pt6_hhv1 AS DOUBLE)"
    return f"""{_FILES},
keyed_persons AS (SELECT *, {_hhid('perv1')} AS HHID FROM persons),
keyed_households AS (SELECT *, {_hhid('hhv1')} AS HHID FROM households),
base AS (
  SELECT p.HHID AS HHID, p.HHID || b4q1_perv1 AS PID, b1q3_perv1 AS Sector_code, state_perv1 AS State_code,
    b4q5_perv1 AS Gender_original, CASE b4q5_perv1 WHEN '3' THEN '1' ELSE b4q5_perv1 END AS Gender_code,
    CASE b4q5_perv1 WHEN '2' THEN 'Female' ELSE 'Male' END AS Gender,
    CAST(b4q6_perv1 AS DOUBLE) AS Age, b4q7_perv1 AS Marital_status, b4q8_perv1 AS General_education,
    b4q11_perv1 AS Attendance_code, b4q12_perv1 AS Training_code, b4pt1q4_perv1 AS Training_field,
    b4pt1q5_perv1 AS Training_duration, b4pt1q6_perv1 AS Training_type,
    CAST(b5pt1q3_perv1 AS INT) AS Principal_status, CAST(b5pt2q3_perv1 AS INT) AS Subsidiary_status,
    b5pt1q5_perv1 AS NIC_principal, b5pt2q5_perv1 AS NIC_subsidiary, b5pt1q6_perv1 AS NCO_principal,
    b5pt2q6_perv1 AS NCO_subsidiary, b5pt1q13_perv1 AS Security_principal, b5pt2q12_perv1 AS Security_subsidiary,
    b5pt3q6_perv1 AS Months_principal, b5pt3q7_perv1 AS Months_subsidiary, b5pt3q8_perv1 AS Efforts_to_find_work,
    b5pt3q9_perv1 AS Unemployment_duration, b5pt3q11_perv1 AS Reason_not_working,
    CAST(no_qtr_perv1 AS INT) AS Contributing_quarters, {weight} AS Weight,
    {quarter} / CAST(no_qtr_perv1 AS DOUBLE) AS Annual_weight, CAST(b6q9_perv1 AS DOUBLE) AS wage_regular_salaried,
    b3q2_hhv1 AS Household_type, b3q3_hhv1 AS Religion, b3q4_hhv1 AS Social_group, {spending} AS Household_monthly_spending,
    CASE WHEN {spending} < 0 THEN NULL WHEN {spending} <= 9999 THEN '1' WHEN {spending} <= 19999 THEN '2'
         WHEN {spending} <= 29999 THEN '3' WHEN {spending} <= 39999 THEN '4' WHEN {spending} <= 49999 THEN '5'
         ELSE '6' END AS Household_spending_band
  FROM keyed_persons p JOIN keyed_households h ON p.HHID = h.HHID WHERE TRUE {keep}),
jobs AS (
  SELECT *, Principal_status IN {_WORK} OR coalesce(Subsidiary_status IN {_WORK}, FALSE) AS Worker,
    {_chosen('Principal_status', 'Subsidiary_status')} AS Status_used,
    {_chosen('NIC_principal', 'NIC_subsidiary')} AS NIC, {_chosen('NCO_principal', 'NCO_subsidiary')} AS NCO,
    {_chosen('Security_principal', 'Security_subsidiary')} AS Social_security,
    {_chosen('Months_principal', 'Months_subsidiary')} AS Economic_months
  FROM base),
prepared AS (
  SELECT *, Worker OR Principal_status = 81 AS Labour_force, Principal_status = 81 AND NOT Worker AS Unemployed,
    CASE WHEN Status_used IN (11, 12) THEN '1' WHEN Status_used = 21 THEN '2' WHEN Status_used = 31 THEN '3'
         WHEN Status_used IN (41, 51) THEN '4' END AS Broad_status,
    left(NIC, 2) AS NIC_division, left(NCO, 1) AS NCO_division, left(NCO, 2) AS NCO_subdivision,
    {_band_case('left(NIC, 2)', cb.NIC_BROAD_BANDS, 'left(NIC, 2)')} AS NIC_broad,
    {_band_case('left(NIC, 2)', cb.NIC_THREE_BANDS, 'left(NIC, 2)')} AS NIC_three,
    {_band_case('Attendance_code', cb.ATTENDANCE_BANDS, 'Attendance_code')} AS Attendance_group
  FROM jobs)"""


_LINE = f"""line_raw AS (
  SELECT {_select({k: v for k, (v, _) in ad.LINE.items() if k != 'Order'})}, l_orderkey AS "Order"
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
line_flags AS (
  SELECT *, Multiplier / CASE WHEN coalesce(NSS = NSC, FALSE) THEN 100.0e0 ELSE 200.0e0 END / Contributing_quarters AS Weight,
    CASE Gender_original WHEN '2' THEN 'Female' ELSE 'Male' END AS Gender,
    Principal_status IN {_WORK} OR coalesce(Subsidiary_status IN {_WORK}, FALSE) AS Worker,
    {_chosen('Principal_status', 'Subsidiary_status')} AS Status_used FROM line_raw),
line AS (
  SELECT *, Worker OR Principal_status = 81 AS Labour_force, Principal_status = 81 AND NOT Worker AS Unemployed,
    CASE WHEN Status_used IN (11, 12) THEN '1' WHEN Status_used = 21 THEN '2' WHEN Status_used = 31 THEN '3'
         WHEN Status_used IN (41, 51) THEN '4' END AS Broad_status FROM line_flags)"""

_AGES = ("ages(Age_group, lo, hi) AS (VALUES "
         + _values([(g.name, g.lower, g.upper) for g in cb.AGE_GROUPS.values()]) + ")")
_SECTORS = "sectors(Sector, sector_own) AS (VALUES ('Rural', '1'), ('Urban', '2'), ('Rural + Urban', NULL))"
_GENDERS = "genders(gender) AS (VALUES ('Male'), ('Female'), ('Persons'))"
_LABELS = ("labels(domain, lcode, label) AS (VALUES "
           + _values([(d, c, t) for d, codes in cb.LABELS.items() for c, t in codes.items()]) + ")")
_SLICED = f"""{_AGES}, {_SECTORS}, {_GENDERS}"""


def _in_slice(row: str = "m") -> str:
    return f"{row}.Age >= a.lo AND (a.hi IS NULL OR {row}.Age <= a.hi)"


_OWN_SECTOR = "(s.sector_own IS NULL OR s.sector_own = m.Sector_code)"


def oracle(name: str, body: str, *ctes: str) -> None:
    """One statement; eliminations are recursive."""
    recursive = "RECURSIVE " if any("_sweep(" in c for c in ctes) else ""
    ORACLES[name] = (f"WITH {recursive}{', '.join(c.strip() for c in ctes)}\n{body}" if ctes else body).strip()


# --- keys, merges, checks ------------------------------------------------------------------------

_MERGE = "CASE WHEN {l} IS NULL THEN 'right_only' WHEN {r} IS NULL THEN 'left_only' ELSE 'both' END"

oracle("merge_m1_orders_customer", f"""
SELECT coalesce(o_custkey, c_custkey) AS custkey, o_orderkey, c_mktsegment,
  {_MERGE.format(l='o_orderkey', r='c_custkey')} AS _merge
FROM orders FULL JOIN customer ON o_custkey = c_custkey""")
oracle("merge_indicator_orders_lineitem", f"""
SELECT {_MERGE.format(l='l_orderkey', r='o_orderkey')} AS _merge, count(*) AS rows
FROM lineitem FULL JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
oracle("merge_1m_customer_orders", f"""
SELECT coalesce(c_custkey, o_custkey) AS custkey,
  CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS amount, c_mktsegment, o_orderkey,
  {_MERGE.format(l='c_custkey', r='o_orderkey')} AS _merge
FROM customer FULL JOIN orders ON o_custkey = c_custkey""")
oracle("merge_11_master_wins", f"""
SELECT coalesce(c_custkey, p_partkey) AS id, CASE WHEN c_custkey IS NULL THEN p_name ELSE c_name END AS name,
  CASE WHEN c_custkey IS NULL THEN p_retailprice ELSE c_acctbal END AS amount, p_brand,
  {_MERGE.format(l='c_custkey', r='p_partkey')} AS _merge
FROM customer FULL JOIN part ON c_custkey = p_partkey""")
oracle("unmatched_sides", """
SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS left_only,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS right_only""")
oracle("merge_rows_preserved", f"""
SELECT (SELECT count(*) FROM persons) AS rows_before, CAST(sum(n) AS BIGINT) AS rows_after,
  count(*) FILTER (WHERE n > 1) AS repeated_keys
FROM (SELECT {_hhid('perv1')} || b4q1_perv1 AS PID, count(*) AS n
      FROM persons LEFT JOIN households ON {_hhid('perv1')} = {_hhid('hhv1')} GROUP BY 1)""", _FILES)


def _agreement(pairs, source):
    return " UNION ALL ".join(
        f"SELECT '{a} = {b}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({a} = {b}, FALSE)) AS violations FROM {source}"
        for a, b in pairs)


oracle("agreement_counts", _agreement(
    [("l_linestatus", "o_orderstatus"), ("l_suppkey", "o_custkey"), ("l_shipdate", "o_orderdate")],
    "lineitem FULL JOIN orders ON l_orderkey = o_orderkey"))
oracle("agreement_coded_files", _agreement(
    [(f"{p.prefix}_perv1", f"{p.prefix}_hhv1") for p in ad.KEY_PARTS] + list(cb.AGREEMENT_FIELDS), "merged"),
    _FILES, f"merged AS (SELECT * FROM persons FULL JOIN households ON {_hhid('perv1')} = {_hhid('hhv1')})")
oracle("duplicate_keys_lineitem",
       "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
oracle("repeated_rows_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
oracle("key_report_lineitem", """
SELECT 'l_orderkey+l_linenumber missing' AS "check",
  (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS violations
UNION ALL SELECT 'l_orderkey+l_linenumber repeated',
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""")


_VISIT_FILES = f"""{_FILES},
hh_again AS (SELECT {_select(ad.REVISIT_HOUSEHOLD)} FROM orders JOIN customer ON o_custkey = c_custkey),
per_again_raw AS (SELECT {_select(ad.REVISIT_PERSON)} FROM ({ad.REVISIT_PERSON_BASE}) b JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey),
per_again AS (SELECT {_select(ad.REVISIT_PERSON)} FROM (SELECT l_orderkey, l_linenumber, max(pk) AS pk, max(sk) AS sk, max(price) AS price, max(flag) AS flag
  FROM ({ad.REVISIT_PERSON_BASE}) GROUP BY ALL) b JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_KEY_NAMES = ("qtr", "visit", "b1q3", "b1q1", "b1q13", "b1q14", "b1q15")


def _visit_key(suffix):
    return " || ".join(f"{c}_{suffix}" for c in _KEY_NAMES)


def _visit_weight(suffix, nss="nss", nsc="nsc"):
    """Single precision; two missing counts agree."""
    return (f"CAST(CAST(CAST(mult_{suffix} AS DOUBLE) / CASE WHEN {nss}_{suffix} IS NOT DISTINCT FROM {nsc}_{suffix} THEN 100.0e0 "
            f"ELSE 200.0e0 END AS FLOAT) AS DOUBLE)")


def _visit_report(level, file, suffix, source, visits, person):
    widths = {"qtr": ("Quarter", 2, "Q[1-4]"), "visit": ("Visit", 2, visits), "b1q3": ("Sector_code", 1, "[0-9]+"), "b1q1": ("FSU", 12, "[0-9]+"),
              "b1q13": ("Hamlet", 1, "[0-9]+"), "b1q14": ("Second_stage_stratum", 1, "[0-9]+"), "b1q15": ("Household_number", 2, "[0-9]+")}
    rules = [(name, f"length({c}_{suffix}) = {width} AND regexp_full_match({c}_{suffix}, '{pattern}')") for c, (name, width, pattern) in widths.items()]
    key, name = _visit_key(suffix), "HHID"
    if person:
        rules.append(("Person_number", f"regexp_full_match(b4q1_{suffix}, '[0-9]{{2}}')"))
        key, name = f"{key} || b4q1_{suffix}", "PID"
    out = [f"SELECT '{level}' AS level, '{file}' AS file, '{rule}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({holds}, FALSE)) AS violations FROM {source}"
           for rule, holds in rules]
    out.append(f"SELECT '{level}', '{file}', '{name} missing', count(*) FILTER (WHERE {key} IS NULL) FROM {source}")
    out.append(f"SELECT '{level}', '{file}', '{name} repeated', count(*) FROM (SELECT 1 FROM {source} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1)")
    return out


oracle("visits_key_report", " UNION ALL ".join(
    _visit_report("household", "first", "hhv1", "all_households", "V1", False) + _visit_report("household", "revisit", "hhrv", "hh_again", "V[2-4]", False)
    + _visit_report("person", "first", "perv1", "persons", "V1", True) + _visit_report("person", "revisit", "perrv", "per_again_raw", "V[2-4]", True)
    + [f"SELECT 'household', 'both', 'HHID in both files', count(*) FROM (SELECT {_visit_key('hhv1')} AS k FROM all_households INTERSECT SELECT {_visit_key('hhrv')} FROM hh_again)",
       f"SELECT 'person', 'both', 'PID in both files', count(*) FROM (SELECT {_visit_key('perv1')} || b4q1_perv1 AS k FROM persons INTERSECT SELECT {_visit_key('perrv')} || b4q1_perrv FROM per_again_raw)"]),
       _VISIT_FILES)
oracle("visits_repeated_records", " UNION ALL ".join(
    f"""SELECT '{file}' AS file, {_visit_key(suffix)} AS HHID, {_visit_key(suffix)} || b4q1_{suffix} AS PID, b4q6_{suffix} AS b4q6, times
FROM (SELECT *, count(*) OVER (PARTITION BY {_visit_key(suffix)}, b4q1_{suffix}) AS times FROM {source}) WHERE times > 1"""
    for file, suffix, source in (("first", "perv1", "persons"), ("revisit", "perrv", "per_again_raw"))), _VISIT_FILES)
_STACKED_HOUSEHOLDS = f"""stacked_households AS (
  SELECT {_visit_key('hhv1')} AS HHID, visit_hhv1 AS Visit, b3q4_hhv1 AS b3q4, b3q2_hhv1 AS b3q2, CAST(NULL AS VARCHAR) AS b3q9, {_visit_weight('hhv1')} AS weight,
    CAST(CAST(CAST(mult_hhv1 AS DOUBLE) / 100.0e0 AS FLOAT) AS DOUBLE) AS weight_plain, 'left_only' AS _merge FROM all_households
  UNION ALL SELECT {_visit_key('hhrv')}, visit_hhrv, b3q4_hhrv, NULL, b3q9_hhrv, {_visit_weight('hhrv')},
    CAST(CAST(CAST(mult_hhrv AS DOUBLE) / 100.0e0 AS FLOAT) AS DOUBLE), 'right_only' FROM hh_again)"""
oracle("visits_stacked", "SELECT * FROM stacked_households", _VISIT_FILES, _STACKED_HOUSEHOLDS)
oracle("visits_attached", f"""
SELECT coalesce(h.HHID, p.HHID) AS HHID, PID, coalesce(h.Visit, p.Visit) AS Visit, b4q5, b4q6, b3q2, b3q9, b4q7,
  CASE WHEN h.HHID IS NULL THEN p.weight ELSE h.weight END AS weight,
  CASE WHEN p.PID IS NULL THEN 'left_only' WHEN h.HHID IS NULL THEN 'right_only' ELSE 'both' END AS _merge
FROM stacked_households h FULL JOIN (
  SELECT {_visit_key('perv1')} AS HHID, {_visit_key('perv1')} || b4q1_perv1 AS PID, visit_perv1 AS Visit, b4q5_perv1 AS b4q5, b4q6_perv1 AS b4q6, b4q7_perv1 AS b4q7,
    {_visit_weight('perv1', 'NSS', 'NSC')} AS weight FROM persons
  UNION ALL SELECT {_visit_key('perrv')}, {_visit_key('perrv')} || b4q1_perrv, visit_perrv, b4q5_perrv, b4q6_perrv, NULL,
    {_visit_weight('perrv', 'NSS', 'NSC')} FROM per_again) p ON h.HHID = p.HHID""", _VISIT_FILES, _STACKED_HOUSEHOLDS)


def _counted(rules, source):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE NOT coalesce({rule}, FALSE)) AS violations FROM {source}"
        for name, rule in rules)


def _part_rules(suffix):
    out = []
    for p in ad.KEY_PARTS:
        c = f"{p.prefix}_{suffix}"
        domain = {"qtr": f"{c} IN ('Q1', 'Q2', 'Q3', 'Q4')", "visit": f"{c} = 'V1'"}.get(
            p.prefix, f"regexp_full_match({c}, '[0-9]+')")
        out.append((c, f"length({c}) = {p.width} AND {domain}"))
    return out


def _key_rules(key, source):
    return (f"SELECT '{key} missing' AS \"check\", count(*) FILTER (WHERE {key} IS NULL) AS violations FROM {source} UNION ALL "
            f"SELECT '{key} repeated', count(*) FROM (SELECT 1 FROM {source} GROUP BY {key} HAVING count(*) > 1)")


oracle("check_report_files", " UNION ALL ".join([
    _counted(_part_rules("perv1") + [("b4q1_perv1 two digits", "regexp_full_match(b4q1_perv1, '[0-9]{2}')")], "persons"),
    _counted(_part_rules("hhv1"), "households"), _key_rules("HHID", "hk"), _key_rules("PID", "pk_")]),
    _FILES, f"hk AS (SELECT {_hhid('hhv1')} AS HHID FROM households)",
    f"pk_ AS (SELECT {_hhid('perv1')} || b4q1_perv1 AS PID FROM persons)")

_ROW_RULES = [
    ("Principal_status documented", f"Principal_status IN {_WORK} OR Principal_status IN (81, 91, 92, 93, 94, 95, 97, 99)"),
    ("Subsidiary_status documented", f"Subsidiary_status IS NULL OR Subsidiary_status IN {_WORK}"),
    ("NIC of a worker has 5 digits", "NOT Worker OR regexp_full_match(NIC, '[0-9]{5}')"),
    ("NCO of a worker has 3 digits", "NOT Worker OR regexp_full_match(NCO, '[0-9]{3}')"),
    ("NIC division of a worker documented", "NOT Worker OR NIC_broad IN ('1', '2', '3', '4', '5', '7', '8', '9', '10')"),
    ("Worker implies Labour_force", "NOT Worker OR Labour_force"),
    ("Worker plus Unemployed is Labour_force", "CAST(Worker AS INT) + CAST(Unemployed AS INT) = CAST(Labour_force AS INT)"),
    ("Broad_status exactly for workers", "(Broad_status IS NOT NULL) = Worker"),
    ("Weight finite and positive", "Weight > 0 AND isfinite(Weight)"),
    ("Social_group documented", "Social_group IN ('1', '2', '3', '9')"),
    ("Religion documented", "Religion IN ('1', '2', '3', '4', '5', '6', '7', '9')"),
    ("Social_security in 1-9 or blank", "Social_security IS NULL OR Social_security IN ('1', '2', '3', '4', '5', '6', '7', '8', '9')"),
    ("Social_security blank for others than employees", "coalesce(Status_used IN (31, 41, 51), FALSE) OR Social_security IS NULL"),
    ("Attendance_code in a documented band", "Attendance_code IS NULL OR Attendance_group IN ('1', '2', '3', '4', '5', '6', '7', '8', '9')"),
    ("Household_monthly_spending nonnegative", "Household_monthly_spending IS NULL OR Household_monthly_spending >= 0"),
]
_FIELD_RULES = [
    ("NSS finite and positive", "CAST(NSS_perv1 AS DOUBLE) > 0"), ("NSC finite and positive", "CAST(NSC_perv1 AS DOUBLE) > 0"),
    ("Multiplier finite and positive", "CAST(mult_perv1 AS DOUBLE) > 0"),
    ("Contributing_quarters finite and positive", "CAST(no_qtr_perv1 AS DOUBLE) > 0"),
    ("Contributing_quarters in 1-4", "CAST(no_qtr_perv1 AS INT) IN (1, 2, 3, 4)"),
    ("Age nonnegative", "CAST(b4q6_perv1 AS DOUBLE) >= 0"),
    ("Gender_original in 1-3", "b4q5_perv1 IN ('1', '2', '3')"), ("Sector_code in 1-2", "b1q3_perv1 IN ('1', '2')"),
]
oracle("check_report_prepared", _counted(_FIELD_RULES, "persons") + " UNION ALL " + _counted(_ROW_RULES, "prepared"), _prepared())
oracle("check_violations", "SELECT PID, failed FROM (SELECT PID, concat_ws('; ', "
       + ", ".join(f"CASE WHEN NOT coalesce({rule}, FALSE) THEN '{name}' END" for name, rule in _ROW_RULES)
       + ") AS failed FROM prepared) WHERE failed <> ''", _prepared())
oracle("composite_key_orders", f"SELECT {_hhid('hhv1')} AS HHID, state_hhv1 FROM households", _FILES)
oracle("stack_visits", """
SELECT o_totalprice AS mult, o_orderpriority AS household_type, 'V1' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS HHID,
  CAST(NULL AS BIGINT) AS lines FROM orders
UNION ALL BY NAME
SELECT max(l_extendedprice) AS mult, count(*) AS lines, 'V2' || lpad(CAST(l_orderkey AS VARCHAR), 16, '0') AS HHID
FROM lineitem GROUP BY l_orderkey""")

# --- derivations ---------------------------------------------------------------------------------

oracle("recode_bands", f"""
SELECT PID, NIC_broad, NIC_three, Attendance_group,
  {_band_case('Attendance_code', cb.ATTENDANCE_BANDS, 'NULL')} AS Attendance_strict FROM prepared""", _prepared())
oracle("spending_bins", """
SELECT c_custkey, CASE WHEN x < 0 THEN NULL WHEN x <= 9999 THEN '1' WHEN x <= 19999 THEN '2' WHEN x <= 29999 THEN '3'
  WHEN x <= 39999 THEN '4' WHEN x <= 49999 THEN '5' WHEN x IS NOT NULL THEN '6' END AS band
FROM (SELECT c_custkey, c_acctbal * 8 AS x FROM customer)""")
oracle("labels_joined", """
SELECT PID, Social_group, Attendance_group, coalesce(a.label, Social_group) AS Social_group_label,
  coalesce(b.label, Attendance_group) AS Attendance_label
FROM prepared LEFT JOIN labels a ON a.domain = 'Social_group' AND a.lcode = Social_group
LEFT JOIN labels b ON b.domain = 'Attendance_group' AND b.lcode = Attendance_group""", _prepared(), _LABELS)
oracle("code_prefix", "SELECT PID, NIC_division, NCO_division, NCO_subdivision FROM prepared", _prepared())
oracle("report_gender", "SELECT Gender_original, Gender, count(*) AS n FROM line GROUP BY 1, 2", _LINE)
oracle("annual_weight", f'SELECT "Order", Line, {R("Multiplier")} AS Multiplier, {R("Weight")} AS Weight FROM line', _LINE)
oracle("historical_weight_float", """
SELECT "Order", Line, CAST(CAST(Multiplier / CASE WHEN NSS IS NOT DISTINCT FROM NSC THEN 100.0e0 ELSE 200.0e0 END AS FLOAT) AS DOUBLE) AS Weight,
  CAST(CAST(Multiplier / 100.0e0 AS FLOAT) AS DOUBLE) AS Weight_plain FROM line""", _LINE)
oracle("activity_flags",
       'SELECT "Order", Line, Principal_status, Subsidiary_status, Worker, Labour_force, Unemployed FROM line', _LINE)
oracle("range_flags", """
SELECT Principal_status, Subsidiary_status, labour_force_ps, labour_force_ss,
  CAST(coalesce(labour_force_ps = 1, FALSE) OR coalesce(labour_force_ss = 1, FALSE) AS INT) AS Labour_force,
  worker_ps, labour_force_ss AS worker_ss,
  CAST(coalesce(worker_ps = 1, FALSE) OR coalesce(labour_force_ss = 1, FALSE) AS INT) AS Worker, count(*) AS n
FROM (SELECT Principal_status, Subsidiary_status,
  CASE WHEN Principal_status BETWEEN 11 AND 51 OR Principal_status = 81 THEN 1 WHEN Principal_status IS NULL THEN 0 END AS labour_force_ps,
  CASE WHEN Subsidiary_status BETWEEN 11 AND 51 THEN 1 WHEN Subsidiary_status IS NULL THEN 0 END AS labour_force_ss,
  CASE WHEN Principal_status BETWEEN 11 AND 51 THEN 1 WHEN Principal_status IS NULL THEN 0 END AS worker_ps FROM line)
GROUP BY ALL""", _LINE)
oracle("selected_job", "SELECT PID, Status_used, NIC, NCO, Social_security, Economic_months FROM prepared", _prepared())


def _status_case(column):
    return (f"CASE WHEN {column} IN (11, 12) THEN '1' WHEN {column} = 21 THEN '2' WHEN {column} = 31 THEN '3' "
            f"WHEN {column} IN (41, 51) THEN '4' END")


oracle("first_nonblank_job", f"""
SELECT "Order", Line, Security_principal, Security_subsidiary,
  CASE WHEN Security_principal <> '' THEN Security_principal WHEN Security_subsidiary <> '' THEN Security_subsidiary END AS first_nonblank,
  {_chosen('Security_principal', 'Security_subsidiary')} AS selected,
  coalesce({_status_case('Principal_status')}, {_status_case('Subsidiary_status')}) AS cascaded_status FROM line""", _LINE)
oracle("status_map", "SELECT Status_used, Broad_status, count(*) AS n FROM line GROUP BY 1, 2", _LINE)
oracle("indicator_columns", """
SELECT "Order", Line, CASE WHEN Labour_force THEN 100.0e0 ELSE 0.0e0 END AS LFPR_percent,
  CASE WHEN Labour_force THEN CASE WHEN Unemployed THEN 100.0e0 ELSE 0.0e0 END END AS UR_percent FROM line""", _LINE)
oracle("dummies", """
SELECT "Order", Line, CASE Marital_status WHEN '2' THEN 1 WHEN '1' THEN 0 END AS dummy_married,
  CASE Sector_code WHEN '2' THEN 1 WHEN '1' THEN 0 END AS dummy_urban, """
       + ", ".join(f"CASE WHEN General_education IN ({', '.join(map(str, codes))}) THEN 1 ELSE 0 END AS {name}"
                   for name, codes in cb.EDUCATION_DUMMIES.items()) + " FROM line", _LINE)
oracle("log_square", f"""
SELECT "Order", Line, {R('CASE WHEN Wage > 0 THEN ln(Wage) END')} AS log_wage, {R('Age * Age')} AS age_sq FROM line""", _LINE)
oracle("group_compare", """
SELECT Social_group, Gender_code, group_compare, female_gen_scst,
  CASE group_compare WHEN 1 THEN 1 WHEN 2 THEN 0 END AS dummy_mg, CASE group_compare WHEN 2 THEN 1 WHEN 1 THEN 0 END AS dummy_fscst,
  CASE female_gen_scst WHEN 1 THEN 1 WHEN 2 THEN 0 END AS dummy_fg, CASE female_gen_scst WHEN 2 THEN 1 WHEN 1 THEN 0 END AS dummy_fe_scst,
  count(*) AS n
FROM (SELECT Social_group, Gender_code,
  CASE WHEN Social_group = '9' AND Gender_code = '1' THEN 1 WHEN Social_group IN ('1', '2') AND Gender_code = '2' THEN 2 END AS group_compare,
  CASE WHEN Social_group = '9' AND Gender_code = '2' THEN 1 WHEN Social_group IN ('1', '2') AND Gender_code = '2' THEN 2 END AS female_gen_scst
  FROM prepared) GROUP BY ALL""", _prepared())
oracle("first_rows", f"""
SELECT {_hhid('perv1')} || b4q1_perv1 AS PID, {_hhid('perv1')} AS HHID, b4q6_perv1 FROM persons ORDER BY 1 LIMIT 5""", _FILES)

# --- populations and tables ----------------------------------------------------------------------

POPULATION_SQL = {
    "All persons": "TRUE", "Workers": "Worker", "Labour force": "Labour_force", "Employees": "Status_used IN (31, 41, 51)",
    "Formal trainees in labour force": "Labour_force AND Training_code = '1'", "Principal unemployed": "Principal_status = 81",
    "Unemployed": "Unemployed", "Non-workers": "NOT Worker",
}
oracle("population_filters", " UNION ALL ".join(
    f"SELECT '{name}' AS Population, count(*) AS Sample, {R('coalesce(sum(Weight), 0)', 5)} AS Weighted FROM prepared WHERE {rule}"
    for name, rule in POPULATION_SQL.items()), _prepared())
oracle("age_sector_slices", f"""
SELECT a.Age_group, s.Sector, count(*) AS n FROM line m JOIN ages a ON {_in_slice()} JOIN sectors s ON {_OWN_SECTOR}
GROUP BY 1, 2""", _LINE, _SLICED)


def _rates(ages, group=None):
    g = f", m.{group} AS {group}" if group else ""
    h = f", {group}" if group else ""
    ages_in = ", ".join(f"'{a}'" for a in ages)
    where = f"WHERE m.{group} IS NOT NULL" if group else ""
    return f"""
SELECT Age_group, Sector{h}, gender AS Gender, n AS Sample_persons, {R('w')} AS Weighted_persons,
  {R('100 * lf / nullif(w, 0)')} AS LFPR, {R('100 * wk / nullif(w, 0)')} AS WPR, {R('100 * un / nullif(lf, 0)')} AS UR
FROM (SELECT Age_group, Sector{h}, g.gender,
    count(*) FILTER (WHERE g.gender IN ('Persons', x.Gender)) AS n,
    coalesce(sum(Weight) FILTER (WHERE g.gender IN ('Persons', x.Gender)), 0) AS w,
    coalesce(sum(Weight) FILTER (WHERE Labour_force AND g.gender IN ('Persons', x.Gender)), 0) AS lf,
    coalesce(sum(Weight) FILTER (WHERE Worker AND g.gender IN ('Persons', x.Gender)), 0) AS wk,
    coalesce(sum(Weight) FILTER (WHERE Unemployed AND g.gender IN ('Persons', x.Gender)), 0) AS un
  FROM (SELECT a.Age_group, s.Sector{g}, m.Gender, m.Weight, m.Labour_force, m.Worker, m.Unemployed
        FROM line m JOIN ages a ON a.Age_group IN ({ages_in}) AND {_in_slice()} JOIN sectors s ON {_OWN_SECTOR} {where}) x
  CROSS JOIN genders g GROUP BY Age_group, Sector{h}, g.gender)"""


oracle("rates_by_age_sector_gender", _rates(["All ages", "15+", "15-29"]), _LINE, _SLICED)
oracle("rates_by_group", _rates(["All ages", "15+"], "Segment"), _LINE, _SLICED)
oracle("rates_by_state", _rates(["15-29"], "State"), _LINE, _SLICED)


def _shares(column, ages, where, group=None, combined=True):
    g = f", m.{group} AS {group}" if group else ""
    h = f", {group}" if group else ""
    ages_in = ", ".join(f"'{a}'" for a in ages)
    pooled = "" if combined else "AND s.sector_own IS NOT NULL"
    return f"""
x AS (SELECT a.Age_group, s.Sector{g}, m.{column} AS Code, m.Gender, m.Weight
      FROM line m JOIN ages a ON a.Age_group IN ({ages_in}) AND {_in_slice()} JOIN sectors s ON {_OWN_SECTOR} {pooled}
      WHERE {where} AND m.{column} IS NOT NULL),
cells AS (SELECT Age_group, Sector{h}, Code, coalesce(sum(Weight) FILTER (WHERE Gender = 'Male'), 0) AS m,
                 coalesce(sum(Weight) FILTER (WHERE Gender = 'Female'), 0) AS f FROM x GROUP BY ALL),
heads AS (SELECT Age_group, Sector{h}, sum(m) AS tm, sum(f) AS tf FROM cells GROUP BY ALL)"""


def _share_columns(m="m", f="f"):
    return (f"{R(f'100 * {m} / nullif(tm, 0)')} AS Male, {R(f'100 * {f} / nullif(tf, 0)')} AS Female, "
            f"{R(f'100 * ({m} + {f}) / nullif(tm + tf, 0)')} AS Persons")


_TOTAL_COLUMNS = ("CASE WHEN tm > 0 THEN 100.0e0 END AS Male, CASE WHEN tf > 0 THEN 100.0e0 END AS Female, "
                  "CASE WHEN tm + tf > 0 THEN 100.0e0 END AS Persons")

oracle("shares_by_gender", f"""
SELECT Age_group, Sector, Code, Code AS Brand, {_share_columns()} FROM cells JOIN heads USING (Age_group, Sector)
UNION ALL SELECT Age_group, Sector, 'total', 'All reported categories', {_TOTAL_COLUMNS} FROM heads""",
       _LINE, _SLICED, _shares("Brand", ["15+"], "m.Worker"))
oracle("shares_by_group", f"""
SELECT Age_group, Sector, Segment, Code, Code AS Type, {_share_columns()} FROM cells JOIN heads USING (Age_group, Sector, Segment)
UNION ALL SELECT Age_group, Sector, Segment, 'total', 'All reported categories', {_TOTAL_COLUMNS} FROM heads""",
       _LINE, _SLICED, _shares("Type", ["15-59"], "m.Labour_force AND m.Segment IS NOT NULL", "Segment", combined=False))
oracle("shares_status_with_totals", f"""
SELECT Age_group, Sector, Code, coalesce(label, 'All reported categories') AS Broad_status, Male, Female, Persons FROM (
  SELECT h.Age_group, h.Sector, c.code AS Code, {_share_columns('coalesce(m, 0)', 'coalesce(f, 0)')}
  FROM heads h CROSS JOIN (VALUES ('1'), ('2'), ('3'), ('4')) c(code)
  LEFT JOIN cells x ON x.Age_group = h.Age_group AND x.Sector = h.Sector AND x.Code = c.code
  UNION ALL
  SELECT h.Age_group, h.Sector, 'self', {_share_columns('coalesce(sm, 0)', 'coalesce(sf, 0)')}
  FROM heads h LEFT JOIN (SELECT Age_group, Sector, sum(m) AS sm, sum(f) AS sf FROM cells WHERE Code IN ('1', '2') GROUP BY 1, 2) y
    ON y.Age_group = h.Age_group AND y.Sector = h.Sector
  UNION ALL SELECT Age_group, Sector, 'total', {_TOTAL_COLUMNS} FROM heads)
LEFT JOIN labels ON domain = 'Broad_status' AND lcode = Code""",
       _LINE, _SLICED, _LABELS, _shares("Broad_status", ["All ages", "15+"], "m.Worker"))
oracle("share_totals_check", f"""
SELECT 'Male' AS Gender, {R('max(abs(a - 100))')} AS max_gap FROM sums UNION ALL
SELECT 'Female', {R('max(abs(b - 100))')} FROM sums UNION ALL SELECT 'Persons', {R('max(abs(c - 100))')} FROM sums""",
       _LINE, _SLICED, _shares("Brand", ["15+"], "m.Worker"),
       """sums AS (SELECT sum(100 * m / nullif(tm, 0)) AS a, sum(100 * f / nullif(tf, 0)) AS b, sum(100 * (m + f) / (tm + tf)) AS c
       FROM cells JOIN heads USING (Age_group, Sector) GROUP BY Age_group, Sector)""")
oracle("mean_table", f"""
SELECT Age_group, Sector, g.gender AS Gender,
  count(*) FILTER (WHERE Spending IS NOT NULL AND g.gender IN ('Persons', x.Gender)) AS Sample_persons,
  {R('''sum(Weight * Spending) FILTER (WHERE g.gender IN ('Persons', x.Gender))
     / sum(Weight) FILTER (WHERE Spending IS NOT NULL AND g.gender IN ('Persons', x.Gender))''')} AS Mean
FROM (SELECT a.Age_group, s.Sector, m.Gender, m.Weight, m.Spending FROM line m
      JOIN ages a ON a.Age_group IN ('All ages', '15+') AND {_in_slice()} JOIN sectors s ON {_OWN_SECTOR}) x
CROSS JOIN genders g GROUP BY Age_group, Sector, g.gender""", _LINE, _SLICED)
oracle("weighted_mean_margins", f"""
SELECT coalesce(Segment, 'Total') AS Segment, coalesce(Gender, 'Total') AS Gender, coalesce(Sector_code, 'Total') AS Sector_code,
  count(*) FILTER (WHERE Labour_force) AS n, {R('coalesce(sum(Weight) FILTER (WHERE Labour_force), 0)')} AS weighted,
  {R('sum(Weight * CASE WHEN Unemployed THEN 100.0e0 ELSE 0 END) FILTER (WHERE Labour_force) / sum(Weight) FILTER (WHERE Labour_force)')} AS mean
FROM line GROUP BY CUBE (Segment, Gender, Sector_code)""", _LINE)
oracle("unpaid_helper_margins", f"""
SELECT coalesce(Social_group, 'Total') AS Social_group, coalesce(Gender, 'Total') AS Gender, coalesce(Sector_code, 'Total') AS Sector_code,
  count(*) AS n, {R('sum(Weight)', 5)} AS weighted,
  {R("sum(Weight * CASE WHEN Broad_status = '2' THEN 100.0e0 ELSE 0 END) / sum(Weight)", 5)} AS mean
FROM prepared WHERE Worker AND Social_group IS NOT NULL GROUP BY CUBE (Social_group, Gender, Sector_code)""", _prepared())


def _crosstab(row, column, source, where, base, by="", places=6):
    h = f"{by}, " if by else ""
    on = {"row": f"PARTITION BY {h}{row}", "column": f"PARTITION BY {h}{column}"}[base]
    margin = {"row": column, "column": row}[base]
    sets = f"({h}{row}, {column}), ({h}{row}), ({h}{column}), ({by})"
    return f"""
SELECT {h}{row}, {column}, n, {R('w', places)} AS weighted,
  {R(f"100 * w / max(CASE WHEN {margin} = 'Total' THEN w END) OVER ({on})", places)} AS percent
FROM (SELECT {h}coalesce({row}, 'Total') AS {row}, coalesce({column}, 'Total') AS {column}, count(*) AS n, sum(Weight) AS w
      FROM {source} WHERE {where} AND {row} IS NOT NULL AND {column} IS NOT NULL GROUP BY GROUPING SETS ({sets}))"""


oracle("crosstab_row", _crosstab("Segment", "Broad_status", "line", "Worker", "row"), _LINE)
oracle("crosstab_col", _crosstab("Brand", "Gender", "line", "Labour_force", "column"), _LINE)
oracle("shares_repeated_by_gender", _crosstab("Type", "Broad_status", "line", "Worker AND Age >= 15", "row", "Gender"), _LINE)
oracle("crosstab_missing", "SELECT Worker, Labour_force, Subsidiary_status, count(*) AS n FROM line GROUP BY ALL", _LINE)


def _oneway(column, source, where, by="", places=6):
    h = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT {h}{column}, n, {R('w', places)} AS weighted, {R(f'100 * w / sum(w) OVER ({part})', places)} AS percent,
  {R(f'100 * sum(w) OVER ({part} ORDER BY {column} ROWS UNBOUNDED PRECEDING) / sum(w) OVER ({part})', places)} AS cumulative
FROM (SELECT {h}{column}, count(*) AS n, sum(Weight) AS w FROM {source} WHERE {where} AND {column} IS NOT NULL GROUP BY ALL)"""


oracle("oneway_cumulative", _oneway("Brand", "line", "Labour_force AND Age >= 15"), _LINE)
oracle("weighted_summary", f"""
SELECT Segment, n, {R('sw')} AS sum_w, {R('mean')} AS mean, {R('sqrt(v * sw / (sw - 1))')} AS sd,
  {R('sqrt(v / (sw - 1))')} AS std_error, {R('lo')} AS min, {R('hi')} AS max
FROM (SELECT Segment, count(*) AS n, sum(Weight) AS sw, sum(Weight * Spending) / sum(Weight) AS mean,
  sum(Weight * Spending * Spending) / sum(Weight) - (sum(Weight * Spending) / sum(Weight)) ** 2 AS v,
  min(Spending) AS lo, max(Spending) AS hi FROM line WHERE Spending IS NOT NULL GROUP BY Segment)""", _LINE)
oracle("mean_over_se", f"""
SELECT Gender, n, {R('mean')} AS mean, {R('se')} AS std_error, {R('mean - 1.959963984540054 * se')} AS ci_low,
  {R('mean + 1.959963984540054 * se')} AS ci_high
FROM (SELECT Gender, n, mean, sqrt(v / (sw - 1)) AS se FROM (
  SELECT Gender, count(*) AS n, sum(Weight) AS sw, sum(Weight * Spending) / sum(Weight) AS mean,
    sum(Weight * Spending * Spending) / sum(Weight) - (sum(Weight * Spending) / sum(Weight)) ** 2 AS v
  FROM line WHERE Spending IS NOT NULL AND Sector_code = '1' GROUP BY Gender))""", _LINE)
oracle("population_total", f"""
SELECT count(*) FILTER (WHERE Broad_status = '2') AS helpers_sample, {R("sum(Weight) FILTER (WHERE Broad_status = '2')")} AS helpers_population,
  count(*) FILTER (WHERE Unemployed) AS seekers_sample, {R('sum(Weight) FILTER (WHERE Unemployed)')} AS seekers_population FROM line""", _LINE)
oracle("levels_present", "SELECT DISTINCT State FROM line WHERE Unemployed AND Age >= 15", _LINE)
oracle("run_audit", f"""
SELECT 'annual' AS mode, 'lineitem, orders, customer' AS input_directory,
  (SELECT count(*) FROM all_households) AS households, (SELECT count(*) FROM persons) AS persons_before_filter,
  (SELECT count(*) FROM prepared) AS matched_persons, CAST(0 AS BIGINT) AS persons_without_household,
  (SELECT count(*) FROM all_households WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS households_without_persons,
  count(*) FILTER (WHERE Gender_original = '3') AS gender_code_3_records,
  count(*) FILTER (WHERE Contributing_quarters < 4) AS persons_with_fewer_than_four_quarters,
  count(*) AS persons_used, {R('sum(Weight)', 5)} AS sum_of_weights FROM prepared""", _prepared())


# --- catalogue -----------------------------------------------------------------------------------

def _catalogue(mode: str, specs=ct.CATALOGUE) -> list[str]:
    members, spec_ages = [], []
    for s in specs:
        spec_ages += [(s.sheet, a) for a in s.ages]
        code = {ct.RATES: "CASE WHEN Worker THEN 'w' WHEN Unemployed THEN 'u' ELSE 'o' END",
                ct.MEANS: "CASE WHEN Household_monthly_spending IS NULL THEN 'n' ELSE 'y' END"}.get(s.kind, s.column)
        members.append(
            f"SELECT '{s.sheet}' AS sheet, '{s.kind}' AS kind, {repr(s.column) if s.column else 'NULL'} AS domain, "
            f"{repr(s.group) if s.group else 'NULL'} AS gdomain, {s.group or 'NULL'} AS gcode, CAST({code} AS VARCHAR) AS code, "
            f"{str(s.combined).upper()} AS combined, Age, Sector_code, Gender, Weight, Household_monthly_spending AS x FROM prepared "
            f"WHERE {POPULATION_SQL[s.population]} AND ({code}) IS NOT NULL" + (f" AND {s.group} IS NOT NULL" if s.group else ""))
    heads = "sheet, domain, gdomain, gcode, Age_group, Sector"
    same = " AND ".join(f"h.{c} IS NOT DISTINCT FROM k.{c}" for c in ("sheet", "gcode", "Age_group", "Sector"))
    share = f"SELECT k.*, tm, tf, tp FROM coded k JOIN totals h ON {same}"
    return [
        _prepared(mode), _SLICED, _LABELS, f"spec_ages(sheet, Age_group) AS (VALUES {_values(spec_ages)})",
        "members AS (" + "\nUNION ALL ".join(members) + ")",
        f"""sliced AS (SELECT m.sheet, kind, domain, gdomain, gcode, code, a.Age_group, s.Sector, m.Gender AS sex, Weight AS w, x
            FROM members m JOIN spec_ages p ON p.sheet = m.sheet JOIN ages a ON a.Age_group = p.Age_group AND {_in_slice()}
            JOIN sectors s ON (s.sector_own = m.Sector_code OR (s.sector_own IS NULL AND m.combined)))""",
        f"""plain AS (SELECT {heads}, code, coalesce(sum(w) FILTER (WHERE sex = 'Male'), 0) AS m,
            coalesce(sum(w) FILTER (WHERE sex = 'Female'), 0) AS f FROM sliced WHERE kind = 'shares' GROUP BY ALL)""",
        f"totals AS (SELECT {heads}, sum(m) AS tm, sum(f) AS tf, sum(m) + sum(f) AS tp FROM plain GROUP BY ALL)",
        f"""coded AS (
            SELECT {heads}, code, m, f FROM plain WHERE domain <> 'Broad_status'
            UNION ALL
            SELECT h.sheet, h.domain, h.gdomain, h.gcode, h.Age_group, h.Sector, h.c AS code, coalesce(k.m, 0), coalesce(k.f, 0)
            FROM (SELECT t.*, c FROM totals t CROSS JOIN (VALUES ('1'), ('2'), ('3'), ('4')) v(c) WHERE domain = 'Broad_status') h
            LEFT JOIN plain k ON {same} AND k.code = h.c
            UNION ALL
            SELECT {heads}, 'self', coalesce(sum(m) FILTER (WHERE code IN ('1', '2')), 0), coalesce(sum(f) FILTER (WHERE code IN ('1', '2')), 0)
            FROM plain WHERE domain = 'Broad_status' GROUP BY {heads})""",
        f"shares AS ({share})",
        f"""tidy AS (
            SELECT {heads}, code, g.gender, 'share' AS measure,
              CASE g.gender WHEN 'Male' THEN 100 * m / nullif(tm, 0) WHEN 'Female' THEN 100 * f / nullif(tf, 0)
                ELSE 100 * (m + f) / nullif(tp, 0) END AS value FROM shares CROSS JOIN genders g
            UNION ALL
            SELECT {heads}, 'total', g.gender, 'share',
              CASE WHEN CASE g.gender WHEN 'Male' THEN tm WHEN 'Female' THEN tf ELSE tp END > 0 THEN 100.0e0 END
            FROM totals CROSS JOIN genders g
            UNION ALL
            SELECT {heads}, NULL, gender, measure, CASE measure WHEN 'n' THEN n WHEN 'weighted' THEN w
              WHEN 'LFPR' THEN 100 * (wk + un) / nullif(w, 0) WHEN 'WPR' THEN 100 * wk / nullif(w, 0) ELSE 100 * un / nullif(wk + un, 0) END
            FROM (SELECT {heads}, g.gender, count(*) FILTER (WHERE g.gender IN ('Persons', sex)) AS n,
                coalesce(sum(w) FILTER (WHERE g.gender IN ('Persons', sex)), 0) AS w,
                coalesce(sum(w) FILTER (WHERE code = 'w' AND g.gender IN ('Persons', sex)), 0) AS wk,
                coalesce(sum(w) FILTER (WHERE code = 'u' AND g.gender IN ('Persons', sex)), 0) AS un
              FROM sliced CROSS JOIN genders g WHERE kind = 'rates' GROUP BY ALL)
            CROSS JOIN (VALUES ('n'), ('weighted'), ('LFPR'), ('WPR'), ('UR')) v(measure)
            UNION ALL
            SELECT {heads}, NULL, gender, measure, CASE measure WHEN 'n' THEN n ELSE wx / nullif(w, 0) END
            FROM (SELECT {heads}, g.gender, count(*) FILTER (WHERE code = 'y' AND g.gender IN ('Persons', sex)) AS n,
                sum(w) FILTER (WHERE code = 'y' AND g.gender IN ('Persons', sex)) AS w,
                sum(w * x) FILTER (WHERE g.gender IN ('Persons', sex)) AS wx
              FROM sliced CROSS JOIN genders g WHERE kind = 'means' GROUP BY ALL)
            CROSS JOIN (VALUES ('n'), ('mean')) v(measure))""",
        """cells AS (SELECT sheet, Age_group, Sector, gcode AS group_code, coalesce(gl.label, gcode) AS group_label, code,
            CASE WHEN code = 'total' THEN 'All reported categories' ELSE coalesce(cl.label, code) END AS label, gender, measure, value
            FROM tidy LEFT JOIN labels gl ON gl.domain = gdomain AND gl.lcode = gcode
            LEFT JOIN labels cl ON cl.domain = tidy.domain AND cl.lcode = code)""",
    ]


_CELLS = f"SELECT sheet, Age_group, Sector, group_code, group_label, code, label, gender, measure, {R('value', 5)} AS value FROM cells"
oracle("catalogue_one_pass", _CELLS, *_catalogue("annual"))
oracle("catalogue_historical", _CELLS, *_catalogue("video"))
oracle("catalogue_headline", f"""
SELECT {R("100 * sum(Weight) FILTER (WHERE Labour_force) / sum(Weight)")} AS LFPR, {R("100 * sum(Weight) FILTER (WHERE Worker) / sum(Weight)")} AS WPR,
  {R("100 * sum(Weight) FILTER (WHERE Unemployed) / sum(Weight) FILTER (WHERE Labour_force)")} AS UR FROM prepared WHERE Age >= 15""", _prepared())
oracle("catalogue_guide", """
SELECT guide.Sheet AS Sheet, Population, Ages, count(*) AS Cells FROM guide JOIN cells ON guide.Sheet = cells.sheet GROUP BY ALL""",
       *_catalogue("annual"),
       "guide(Sheet, Population, Ages) AS (VALUES " + _values([(s.sheet, s.population, "; ".join(s.ages)) for s in ct.CATALOGUE]) + ")")
oracle("historical_industry_table", _crosstab("industry", "Gender", "hist", "Labour_force AND Sector_code = '1'", "column", places=5),
       _prepared("video"),
       f"""hist AS (SELECT *, {_band_case("left(coalesce(NIC_principal, NIC_subsidiary), 2)", cb.NIC_BROAD_BANDS,
                                         "left(coalesce(NIC_principal, NIC_subsidiary), 2)")} AS industry FROM prepared)""")
oracle("historical_training_oneway", _oneway("Training_code", "prepared", "Labour_force AND Age >= 15", "Sector_code, Gender", 5),
       _prepared("video"))

# Codes, bands and slices of the historical tables, written out here again.
_HISTORY = """
hist_codes AS (SELECT *, left(coalesce(NIC_principal, NIC_subsidiary), 2) AS Industry, coalesce(NCO_principal, NCO_subsidiary) AS Occupation,
    coalesce(Security_principal, Security_subsidiary) AS Benefits, coalesce(Months_principal, Months_subsidiary) AS Months,
    CASE WHEN Principal_status IN (11, 12) THEN '1' WHEN Principal_status = 21 THEN '2' WHEN Principal_status = 31 THEN '3'
         WHEN Principal_status IN (41, 51) THEN '4' WHEN Subsidiary_status IN (11, 12) THEN '1' WHEN Subsidiary_status = 21 THEN '2'
         WHEN Subsidiary_status = 31 THEN '3' WHEN Subsidiary_status IN (41, 51) THEN '4' END AS Status FROM prepared),
hist AS (SELECT *, left(Occupation, 1) AS Occupation_division, left(Occupation, 2) AS Occupation_subdivision,
    CASE WHEN CAST(Industry AS INT) BETWEEN 1 AND 3 THEN '1' WHEN CAST(Industry AS INT) BETWEEN 5 AND 9 THEN '2'
         WHEN CAST(Industry AS INT) BETWEEN 10 AND 33 THEN '3' WHEN CAST(Industry AS INT) BETWEEN 35 AND 39 THEN '4'
         WHEN CAST(Industry AS INT) BETWEEN 41 AND 43 THEN '5' WHEN CAST(Industry AS INT) BETWEEN 45 AND 47 THEN '7'
         WHEN CAST(Industry AS INT) BETWEEN 49 AND 53 THEN '8' WHEN CAST(Industry AS INT) BETWEEN 55 AND 56 THEN '9'
         WHEN CAST(Industry AS INT) BETWEEN 58 AND 99 THEN '10' ELSE Industry END AS Industry_broad,
    CASE WHEN CAST(Industry AS INT) BETWEEN 1 AND 3 THEN '1' WHEN CAST(Industry AS INT) BETWEEN 5 AND 43 THEN '6'
         WHEN CAST(Industry AS INT) BETWEEN 45 AND 99 THEN '11' ELSE Industry END AS Industry_three FROM hist_codes),
both_weights AS (SELECT *, 'historical' AS weighting, Weight AS w FROM hist UNION ALL SELECT *, 'annual', Annual_weight FROM hist)"""
_HIST_AGES = {"all": ("All ages", "Age >= 0"), "15": ("15+", "Age >= 15"), "youth": ("15-29", "Age BETWEEN 15 AND 29"), "adult": ("15-59", "Age BETWEEN 15 AND 59")}
_FLAG = "CAST(CAST({} AS INT) AS VARCHAR)"
# (table, column, who, ages, group, total, pooled sectors, running, only)
_HIST_TABLES = [
    ("lfpr_social_group", _FLAG.format("Labour_force"), "TRUE", ["all"], "Social_group", True, True, False, "1"),
    ("wpr_social_group", _FLAG.format("Worker"), "TRUE", ["all"], "Social_group", True, True, False, "1"),
    ("ur_social_group", _FLAG.format("Unemployed"), "Labour_force", ["all"], "Social_group", True, True, False, "1"),
    ("lfpr_state_youth", _FLAG.format("Labour_force"), "TRUE", ["youth"], "State_code", True, True, False, "1"),
    ("labour_force_social_group", _FLAG.format("Labour_force"), "TRUE", ["all"], "Social_group", True, True, False, None),
    ("industry_division", "Industry", "Labour_force", ["all"], None, False, True, False, None),
    ("industry_broad", "Industry_broad", "Labour_force", ["all"], None, False, True, False, None),
    ("industry_three", "Industry_three", "Labour_force", ["all"], None, False, True, False, None),
    ("status_industry_broad", "Status", "Labour_force", ["all", "15"], "Industry_broad", True, True, False, None),
    ("status_industry_three", "Status", "Labour_force", ["all", "15"], "Industry_three", True, True, False, None),
    ("status_labour_force", "Status", "Labour_force", ["all"], None, False, True, False, None),
    ("status_everybody", "Status", "TRUE", ["15"], None, False, True, False, None),
    ("training_everybody", "Training_code", "TRUE", ["adult"], None, False, True, True, None),
    ("training_labour_force", "Training_code", "Labour_force", ["15"], None, False, True, True, None),
    ("occupation_group", "Occupation", "Labour_force", ["all", "15"], None, False, True, False, None),
    ("status_social_group", "Status", "Labour_force", ["15"], "Social_group", False, True, False, None),
    ("status_religion", "Status", "Labour_force", ["15"], "Religion", False, True, False, None),
    ("household_type", "Household_type", "Labour_force", ["15"], None, False, False, False, None),
] + [(name, column, "Labour_force", ["15"], None, False, True, False, None) for name, column in (
    ("occupation_division", "Occupation_division"), ("occupation_subdivision", "Occupation_subdivision"), ("benefits", "Benefits"),
    ("religion", "Religion"), ("social_group", "Social_group"), ("spending_band", "Household_spending_band"), ("marital_status", "Marital_status"),
    ("attendance", "Attendance_group"), ("training_field", "Training_field"), ("training_duration", "Training_duration"),
    ("training_type", "Training_type"), ("activity_duration", "Months"), ("search_efforts", "Efforts_to_find_work"),
    ("unemployment_spell", "Unemployment_duration"), ("reason_not_working", "Reason_not_working"))]


def _hist_table(name, column, who, ages, group, total, pooled, running, only):
    """One statement per age group and, for tables with a total, per grouping."""
    out = []
    for age in ages:
        label, inside = _HIST_AGES[age]
        for grouping in ([group, "'Total'"] if group and total else [group or "NULL"]):
            need = f"AND {group} IS NOT NULL" if group else ""
            sectors = "" if pooled else "WHERE Sector <> 'Rural + Urban'"
            slice_ = 'PARTITION BY Sector, gender, "group", weighting'
            out.append(f"""
SELECT '{name}' AS "table", '{label}' AS Age_group, Sector, gender AS Gender, "group", code, weighting, n, percent, running FROM (
  SELECT *, {R(f'100 * sw / sum(sw) OVER ({slice_})', 5)} AS percent,
    {R(f'100 * sum(sw) OVER ({slice_} ORDER BY code) / sum(sw) OVER ({slice_})', 5) if running else 'CAST(NULL AS DOUBLE)'} AS running FROM (
    SELECT Sector, g.gender AS gender, CAST({grouping} AS VARCHAR) AS "group", {column} AS code, weighting, count(*) AS n, sum(w) AS sw
    FROM both_weights m JOIN (SELECT * FROM sectors {sectors}) s ON {_OWN_SECTOR} JOIN genders g ON g.gender IN (m.Gender, 'Persons')
    WHERE {who} AND {inside} AND {column} IS NOT NULL {need} GROUP BY ALL)) {f"WHERE code = '{only}'" if only else ''}""")
    return " UNION ALL ".join(out)


oracle("historical_tables", " UNION ALL ".join(_hist_table(*t) for t in _HIST_TABLES), _prepared("video"), _HISTORY, _SECTORS, _GENDERS)
oracle("historical_spending_means", f"""
SELECT Sector, gender AS Gender, n, {R('mean', 4)} AS mean, {R('sqrt(v / (sw - 1))', 4)} AS std_error FROM (
  SELECT Sector, g.gender AS gender, count(*) AS n, sum(Weight) AS sw, sum(Weight * Household_monthly_spending) / sum(Weight) AS mean,
    sum(Weight * Household_monthly_spending ** 2) / sum(Weight) - (sum(Weight * Household_monthly_spending) / sum(Weight)) ** 2 AS v
  FROM prepared m JOIN sectors s ON {_OWN_SECTOR} JOIN genders g ON g.gender IN (m.Gender, 'Persons')
  WHERE Household_monthly_spending IS NOT NULL GROUP BY ALL)""", _prepared("video"), _SECTORS, _GENDERS)

# --- percentiles and models ----------------------------------------------------------------------


def _percentiles(value, source, probabilities, by="", where="TRUE"):
    h = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    same = f"AND c.{by} IS NOT DISTINCT FROM n.{by}" if by else ""
    return f"""
sums AS (SELECT {h}{value} AS y, sum(Weight) AS w FROM {source} WHERE {value} IS NOT NULL AND Weight > 0 AND {where} GROUP BY ALL),
running AS (SELECT *, sum(w) OVER ({part} ORDER BY y ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER ({part}) AS total,
            lead(y) OVER ({part} ORDER BY y) AS following FROM sums),
percentiles AS (SELECT {h}p, min(CASE WHEN abs(upto - p * total) <= 1e-12 * p * total THEN (y + coalesce(following, y)) / 2 ELSE y END) AS value
  FROM running CROSS JOIN (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in probabilities)}) v(p)
  WHERE upto >= p * total * (1 - 1e-12) GROUP BY ALL)"""


oracle("weighted_percentiles", f"SELECT p, {R('value')} AS value FROM percentiles", _LINE,
       _percentiles("Wage", "line", [0.1, 0.25, 0.5, 0.75, 0.9]))
oracle("weighted_percentiles_by_group", f"SELECT Segment, p, {R('value')} AS value FROM percentiles", _LINE,
       _percentiles("Spending", "line", [0.25, 0.5, 0.75], "Segment"))
_WAGES = """wages AS (SELECT *, CASE WHEN Wage > 0 THEN ln(Wage) END AS log_wage,
  CASE Sector_code WHEN '2' THEN 1 WHEN '1' THEN 0 END AS urban, CASE Gender WHEN 'Female' THEN 1 ELSE 0 END AS female FROM line)"""
_P3 = [0.25, 0.75, 0.9]
_Q3 = ", ".join(f"(SELECT value FROM percentiles WHERE p = {p}) AS q{round(100 * p)}" for p in _P3)
oracle("rif_reference", "SELECT Segment, " + ", ".join(
    R(f"avg(q{i} - CASE WHEN log_wage <= q{i} THEN 1 ELSE 0 END / ({p} * (1 - {p})))") + f" AS rif{i}"
    for p, i in zip(_P3, (25, 75, 90))) + ", count(*) AS n FROM wages, q GROUP BY Segment",
    _LINE, _WAGES, _percentiles("log_wage", "wages", _P3), f"q AS (SELECT {_Q3})")
oracle("rif_standard", "SELECT Segment, " + ", ".join(
    R(f"avg(q{i} + ({p} - CASE WHEN log_wage <= q{i} THEN 1 ELSE 0 END) / f{i}) FILTER (WHERE log_wage IS NOT NULL)") + f" AS rif{i}"
    for p, i in zip(_P3, (25, 75, 90))) + ", count(log_wage) AS n FROM wages, q, dens GROUP BY Segment",
    _LINE, _WAGES, _percentiles("log_wage", "wages", _P3), f"q AS (SELECT {_Q3})",
    """band AS (SELECT 1.06 * sqrt(sum(Weight * log_wage * log_wage) / sum(Weight) - (sum(Weight * log_wage) / sum(Weight)) ** 2)
       * count(*) ** -0.2 AS h, sum(Weight) AS sw FROM wages WHERE log_wage IS NOT NULL AND Weight > 0)""",
    "dens AS (SELECT " + ", ".join(
        f"sum(Weight * exp(-0.5 * ((log_wage - q{i}) / h) ** 2)) / (any_value(sw) * any_value(h) * sqrt(2 * pi())) AS f{i}" for i in (25, 75, 90))
    + " FROM wages, q, band WHERE log_wage IS NOT NULL AND Weight > 0)")
_FIVE = (0.1, 0.25, 0.5, 0.75, 0.9)
oracle("quantile_by_dummy", f"""
SELECT a.p AS tau, term, {R("CASE term WHEN '_cons' THEN a.value ELSE b.value - a.value END")} AS estimate, n
FROM percentiles a JOIN percentiles b ON a.p = b.p AND a.female = 0 AND b.female = 1 CROSS JOIN (VALUES ('female'), ('_cons')) t(term)
CROSS JOIN (SELECT count(*) AS n FROM wages WHERE log_wage IS NOT NULL AND Weight > 0)""",
       _LINE, _WAGES, _percentiles("log_wage", "wages", _FIVE, "female"))
oracle("quantile_optimality", f"""
SELECT CAST(tau AS DOUBLE) AS tau, term, n, TRUE AS optimal
FROM (VALUES {', '.join(f'({t})' for t in _FIVE)}) q(tau)
CROSS JOIN (VALUES ('Age'), ('age_sq'), ('urban'), ('Line'), ('Discount'), ('female'), ('_cons')) t(term)
CROSS JOIN (SELECT count(*) AS n FROM wages WHERE log_wage IS NOT NULL AND Age IS NOT NULL AND urban IS NOT NULL AND Weight > 0)""",
       _LINE, _WAGES)
_SAMPLE = "sample AS (SELECT * FROM wages WHERE log_wage IS NOT NULL AND Age IS NOT NULL AND urban IS NOT NULL AND Weight IS NOT NULL)"
oracle("estimation_sample", f"""
SELECT Segment, count(*) AS n, {R('sum(log_wage)')} AS total, {R('sum(Weight)')} AS weighted FROM sample
WHERE Age >= 15 GROUP BY Segment""", _LINE, _WAGES, _SAMPLE)
_Z = {"_cons": "1.0e0", "Age": "Age", "urban": "urban", "log_wage": "log_wage"}
oracle("gram_matrix", " UNION ALL ".join(
    f"SELECT Gender, count(*) AS n, '{a}' AS row_term, '{b}' AS column_term, {R(f'sum(Weight * {_Z[a]} * {_Z[b]})')} AS total FROM sample GROUP BY Gender"
    for i, a in enumerate(_Z) for b in list(_Z)[i:]), _LINE, _WAGES, _SAMPLE)


def _ols(x, weight, by, source="sample", y="log_wage"):
    """One regressor: moments about the means, then the textbook formulas."""
    h = f"{by}, " if by else ""
    join = f"JOIN means USING ({by})" if by else "CROSS JOIN means"
    return f"""
means AS (SELECT {h}sum({weight} * {x}) / sum({weight}) AS mx, sum({weight} * {y}) / sum({weight}) AS my FROM {source} {f'GROUP BY {by}' if by else ''}),
moments AS (SELECT {h}count(*) AS n, sum({weight}) AS sw, any_value(mx) AS mx, any_value(my) AS my,
  sum({weight} * ({x} - mx) ** 2) AS sxx, sum({weight} * ({x} - mx) * ({y} - my)) AS sxy, sum({weight} * ({y} - my) ** 2) AS syy
  FROM {source} {join} {f'GROUP BY {by}' if by else ''}),
fits AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a, (syy - sxy * sxy / sxx) / (n - 2) * n / sw AS s2, sxy * sxy / sxx / syy AS r2 FROM moments),
errors AS (SELECT *, sqrt(s2 / (sxx * n / sw)) AS sb, sqrt(s2 * (1 / (n * 1.0e0) + mx * mx / (sxx * n / sw))) AS sa FROM fits)"""


def _ols_rows(term, by=""):
    h = f"{by}, " if by else ""
    return f"""
SELECT {h}'log_wage' AS y, '{term}' AS term, {R('b')} AS estimate, {R('sb')} AS std_error, {R('b / sb')} AS t, FALSE AS omitted, n, {R('r2')} AS r2 FROM errors
UNION ALL SELECT {h}'log_wage', '_cons', {R('a')}, {R('sa')}, {R('a / sa')}, FALSE, n, {R('r2')} FROM errors"""


oracle("ols_one_regressor", _ols_rows("Age"), _LINE, _WAGES, _SAMPLE, _ols("Age", "Weight", ""))
oracle("ols_by_group", _ols_rows("Line", "Segment"), _LINE, _WAGES,
       "sample AS (SELECT * FROM wages WHERE log_wage IS NOT NULL)", _ols("Line", "1.0e0", "Segment"))


def _gap(weight, by=""):
    """Group moments of one regressor side by side, with variances of means and coefficients."""
    h = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    return f"""
var AS (SELECT {h}female, n, mx, my, a, b, sxx / sw / (n - 1) AS vx, syy / sw / (n - 1) AS vy,
  s2 / (sxx * n / sw) AS vb, s2 * (1 / (n * 1.0e0) + mx * mx / (sxx * n / sw)) AS va, -mx * s2 / (sxx * n / sw) AS cab FROM fits),
gap AS (SELECT {'a.' + by + ', ' if by else ''}a.mx AS x1, b.mx AS x2, a.my AS y1, b.my AS y2, a.a AS a1, b.a AS a2, a.b AS b1, b.b AS b2,
  a.vx AS vx1, b.vx AS vx2, a.vy AS vy1, b.vy AS vy2, a.vb AS vb1, b.vb AS vb2, a.va AS va1, b.va AS va2, a.cab AS c1, b.cab AS c2
  FROM var a JOIN var b ON {on}a.female = 0 AND b.female = 1)"""


def _parts(parts, by=""):
    h = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {h}'log_wage' AS y, '{name}' AS part, '(all)' AS term, {R(value)} AS estimate, {R(f'sqrt({variance})')} AS std_error FROM gap"
        for name, value, variance in parts)


_LEVELS = [("group_1", "y1", "vy1"), ("group_2", "y2", "vy2"), ("difference", "y1 - y2", "vy1 + vy2")]
_THREE = [
    ("endowments", "(x1 - x2) * b2", "(x1 - x2) ** 2 * vb2 + b2 ** 2 * (vx1 + vx2)"),
    ("coefficients", "x2 * (b1 - b2) + a1 - a2",
     "x2 ** 2 * (vb1 + vb2) + (va1 + va2) + 2 * x2 * (c1 + c2) + (b1 - b2) ** 2 * vx2"),
    ("interaction", "(x1 - x2) * (b1 - b2)", "(x1 - x2) ** 2 * (vb1 + vb2) + (b1 - b2) ** 2 * (vx1 + vx2)"),
]
oracle("oaxaca_threefold", _parts(_LEVELS + _THREE), _LINE, _WAGES, _SAMPLE, _ols("Age", "Weight", "female"), _gap("Weight"))
oracle("oaxaca_by_segment", _parts(_LEVELS + _THREE, "Segment"), _LINE, _WAGES,
       "sample AS (SELECT * FROM wages WHERE log_wage IS NOT NULL)",
       _ols("Line", "1.0e0", "Segment, female"), _gap("1.0e0", "Segment"))
# The pooled slope with a group indicator is the within-group slope.
_STAR = """
within AS (SELECT sum(sxy) / sum(sxx) AS bs, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS rss, sum(sxx) AS wxx, CAST(sum(n) AS DOUBLE) AS nn, sum(sw) AS sww,
  max(CASE WHEN female = 0 THEN sw END) AS sw1 FROM moments),
star AS (SELECT *, rss / (nn - 3) * nn / sww AS s2s FROM within)"""
_POOLED_GAP = """
pooled_gap AS (SELECT *, bs AS b0, y1 - bs * x1 AS a0, s2s / (wxx * nn / sww) AS vb0,
  s2s * (sww / (nn * sw1)) + x1 * x1 * s2s / (wxx * nn / sww) AS va0, -x1 * s2s / (wxx * nn / sww) AS c0 FROM gap CROSS JOIN star)"""
oracle("oaxaca_pooled", _parts(_LEVELS + [
    ("explained", "(x1 - x2) * b0", "(x1 - x2) ** 2 * vb0 + b0 ** 2 * (vx1 + vx2)"),
    ("unexplained", "x1 * (b1 - b0) + (a1 - a0) + x2 * (b0 - b2) + (a0 - a2)",
     "x1 ** 2 * (vb1 + vb0) + (va1 + va0) + 2 * x1 * (c1 + c0) + (b1 - b0) ** 2 * vx1 "
     "+ x2 ** 2 * (vb2 + vb0) + (va2 + va0) + 2 * x2 * (c2 + c0) + (b0 - b2) ** 2 * vx2"),
]).replace("FROM gap", "FROM pooled_gap"), _LINE, _WAGES, _SAMPLE, _ols("Age", "Weight", "female"), _gap("Weight"), _STAR, _POOLED_GAP)


# --- models with several regressors ---------------------------------------------------------------

def _elimination(name: str, rows: str, keys: list[str], x: list[str], kind: str, least: str = "1e-9") -> str:
    """Least squares by Gauss-Jordan sweeps of the moment matrix of (1, x, y), shifted to plain means.

    ``rows`` has the keys, w, the columns of x, and y.  The result ``{name}`` holds lists in the order (intercept, x): ``b`` and ``cov`` in original
    units, ``kept``, means ``xm`` with their covariance ``vm``, and n, r2, ym, vym.  A column whose part not explained by earlier ones is below
    ``least`` of it is skipped.  ``kind`` says what counts as the number of observations: n or the sum of weights sw.
    """
    d, k1 = len(x) + 2, len(x) + 1
    h = "".join(f"{k}, " for k in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    join = f"JOIN {name}_shift USING ({', '.join(keys)})" if keys else f"CROSS JOIN {name}_shift"
    z = ["1.0e0", *[f"({c} - s[{i}])" for i, c in enumerate(x, 1)], f"(y - s[{k1}])"]
    sums = ", ".join(f"sum(w * {a} * {b})" for a in z for b in z)
    pivot = f"m[k * {d + 1} + 1]"
    cell = (f"CASE WHEN p // {d} = k AND p % {d} = k THEN 1 / {pivot} WHEN p // {d} = k THEN m[p + 1] / {pivot} "
            f"WHEN p % {d} = k THEN -m[p + 1] / {pivot} ELSE m[p + 1] - m[p // {d} * {d} + k + 1] * m[k * {d} + p % {d} + 1] / {pivot} END")
    good = f"m0[k * {d + 1} + 1] > 0 AND {pivot} > {least} * m0[k * {d + 1} + 1]"
    return f"""
{name}_shift AS (SELECT {h}[{', '.join(f'avg({c})' for c in [*x, 'y'])}] AS s FROM {rows} {by}),
{name}_moments AS (SELECT {h}count(*) AS n, any_value(s) AS s, [{sums}] AS m0 FROM {rows} {join} {by}),
{name}_sweep(k, {h}n, s, m0, m, kept) AS (
  SELECT 0, {h}n, s, m0, m0, CAST([] AS BOOLEAN[]) FROM {name}_moments
  UNION ALL SELECT k + 1, {h}n, s, m0, CASE WHEN {good} THEN list_transform(range({d * d}), lambda p: {cell}) ELSE m END, list_append(kept, {good})
  FROM {name}_sweep WHERE k < {k1}),
{name}_solved AS (SELECT *, m0[1] AS sw, len(list_filter(kept, lambda f: f)) AS kk, greatest(m[{d * d}], 0.0e0) AS rss FROM {name}_sweep WHERE k = {k1}),
{name}_units AS (SELECT *, rss / ({kind} - kk) AS s2, list_prepend(1.0e0, list_transform(s[1:{k1 - 1}], lambda v: -v)) AS back,
  list_transform(range({k1}), lambda i: CASE WHEN kept[i + 1] THEN m[i * {d} + {d}] ELSE 0.0e0 END) AS b0 FROM {name}_solved),
{name}_cov AS (SELECT *, list_transform(range({k1 * k1}), lambda p: CASE WHEN kept[p // {k1} + 1] AND kept[p % {k1} + 1]
  THEN m[p // {k1} * {d} + p % {k1} + 1] * s2 ELSE 0.0e0 END) AS c FROM {name}_units),
{name}_back AS (SELECT *, list_transform(range({k1}), lambda j: list_sum(list_transform(range({k1}), lambda a: back[a + 1] * c[a * {k1} + j + 1]))) AS row0
  FROM {name}_cov),
{name} AS (SELECT {h}n, sw, kept, 1 - rss / (m0[{d * d}] - m0[{d}] ** 2 / sw) AS r2,
  list_transform(range({k1}), lambda i: CASE WHEN i = 0 THEN s[{k1}] + list_sum(list_transform(range({k1}), lambda a: b0[a + 1] * back[a + 1])) ELSE b0[i + 1] END) AS b,
  list_transform(range({k1 * k1}), lambda p: CASE WHEN p = 0 THEN list_sum(list_transform(range({k1}), lambda j: row0[j + 1] * back[j + 1]))
    WHEN p < {k1} THEN row0[p + 1] WHEN p % {k1} = 0 THEN row0[p // {k1} + 1] ELSE c[p + 1] END) AS cov,
  list_transform(range({k1}), lambda i: CASE WHEN i = 0 THEN 1.0e0 ELSE m0[i + 1] / sw - back[i + 1] END) AS xm,
  list_transform(range({k1 * k1}), lambda p: CASE WHEN p < {k1} OR p % {k1} = 0 THEN 0.0e0 ELSE
    (m0[p // {k1} * {d} + p % {k1} + 1] / sw - m0[p // {k1} + 1] / sw * m0[p % {k1} + 1] / sw) / ({kind} - 1) END) AS vm,
  m0[{d}] / sw + s[{k1}] AS ym, (m0[{d * d}] / sw - (m0[{d}] / sw) ** 2) / ({kind} - 1) AS vym FROM {name}_back)"""


def _terms(x: list[str]) -> str:
    """(i, term) with the intercept at 0."""
    return "terms(i, term) AS (VALUES " + _values([(i, t) for i, t in enumerate(["_cons", *x])]) + ")"


def _coefficients(name: str, head: str, size: int) -> str:
    error = f"sqrt(greatest(cov[i * {size + 1} + 1], 0))"
    return f"""
SELECT {head}term, {R('b[i + 1]')} AS estimate, {R(error)} AS std_error, {R(f'CASE WHEN {error} > 0 THEN b[i + 1] / {error} END')} AS t,
  NOT kept[i + 1] AS omitted, n, {R('r2')} AS r2 FROM {name} CROSS JOIN terms"""


def _quadratic(vector: str, matrix: str, size: int) -> str:
    return f"list_sum(list_transform(range({size * size}), lambda p: {vector}[p // {size} + 1] * {matrix}[p + 1] * {vector}[p % {size} + 1]))"


def _plus(a: str, b: str, size: int, sign: str = "+") -> str:
    return f"list_transform(range({size}), lambda i: {a}[i + 1] {sign} {b}[i + 1])"


def _gap_parts(head: str, source: str, size: int, detail: bool, twofold: bool = False) -> str:
    """Levels and parts from ``source`` with both sides' lists (suffix 1 and 2), and the pooled ones (suffix s) for a twofold split."""
    levels = " UNION ALL ".join(
        f"SELECT {head}'{part}' AS part, '(all)' AS term, {R(value)} AS estimate, {R(f'sqrt({variance})')} AS std_error FROM {source}"
        for part, value, variance in (("group_1", "ym1", "vym1"), ("group_2", "ym2", "vym2"), ("difference", "ym1 - ym2", "vym1 + vym2")))
    products = ([("explained", "gap", "gapv", "bs", "cs")] if twofold else
                [("endowments", "gap", "gapv", "b2", "c2"), ("coefficients", "xm2", "vm2", "slope", "slopev"), ("interaction", "gap", "gapv", "slope", "slopev")])

    def total(left, left_cov, right, right_cov):
        return f"list_dot_product({left}, {right})", f"({_quadratic(left, right_cov, size)} + {_quadratic(right, left_cov, size)})"

    out = [levels]
    for part, *names in products:
        value, variance = total(*names)
        out.append(f"SELECT {head}'{part}', '(all)', {R(value)}, {R(f'sqrt(greatest({variance}, 0))')} FROM {source}")
        if detail:
            left, left_cov, right, right_cov = names
            at = f"i * {size + 1} + 1"
            out.append(f"""SELECT {head}'{part}', term, {R(f'{left}[i + 1] * {right}[i + 1]')},
  {R(f'sqrt(greatest({left}[i + 1] ** 2 * {right_cov}[{at}] + {right}[i + 1] ** 2 * {left_cov}[{at}], 0))')} FROM {source} CROSS JOIN terms""")
    if twofold:
        (v1, q1), (v2, q2) = total("xm1", "vm1", "over1", "over1v"), total("xm2", "vm2", "over2", "over2v")
        out.append(f"SELECT {head}'unexplained', '(all)', {R(f'{v1} + {v2}')}, {R(f'sqrt(greatest({q1}, 0) + greatest({q2}, 0))')} FROM {source}")
    return " UNION ALL ".join(out)


def _both_sides(name: str, fits: str, keys: list[str], side: str, size: int, star: str = "") -> str:
    """Side 0 and side 1 of ``fits`` next to each other, with what parts are made of."""
    on = " AND ".join([f"a.{k} = b.{k}" for k in keys] + [f"a.{side} = 0", f"b.{side} = 1"])
    h = "".join(f"a.{k}, " for k in keys)
    pooled = f", list_transform(range({size}), lambda i: p.b[i + 1]) AS bs, p.cov AS pc" if star else ""
    joined = f"JOIN {star} p ON {' AND '.join(f'a.{k} = p.{k}' for k in keys) or 'TRUE'}" if star else ""
    wide = size + 1
    more = f""", list_transform(range({size * size}), lambda i: pc[i // {size} * {wide} + i % {size} + 1]) AS cs""" if star else ""
    over = (f""", {_plus('b1', 'bs', size, '-')} AS over1, {_plus('c1', 'cs', size * size)} AS over1v, {_plus('bs', 'b2', size, '-')} AS over2,
  {_plus('cs', 'c2', size * size)} AS over2v""" if star else "")
    return f"""
{name}_pairs AS (SELECT {h}a.xm AS xm1, b.xm AS xm2, a.vm AS vm1, b.vm AS vm2, a.b AS b1, b.b AS b2, a.cov AS c1, b.cov AS c2, a.ym AS ym1, b.ym AS ym2,
  a.vym AS vym1, b.vym AS vym2{pooled} FROM {fits} a JOIN {fits} b ON {on} {joined}),
{name}_stars AS (SELECT *{more} FROM {name}_pairs),
{name} AS (SELECT *, {_plus('xm1', 'xm2', size, '-')} AS gap, {_plus('vm1', 'vm2', size * size)} AS gapv, {_plus('b1', 'b2', size, '-')} AS slope,
  {_plus('c1', 'c2', size * size)} AS slopev{over} FROM {name}_stars)"""


_MANY = ["Age", "age_sq", "urban", "Line", "Discount"]
_MANY_ROWS = """many AS (SELECT *, log_wage AS y, Weight AS w, 2 * urban AS twice_urban FROM (SELECT *, Age * Age AS age_sq FROM wages)
  WHERE log_wage IS NOT NULL AND Age IS NOT NULL AND urban IS NOT NULL AND Line IS NOT NULL AND Discount IS NOT NULL AND Weight IS NOT NULL)"""
_MANY_X = [*_MANY, "female", "twice_urban"]
oracle("ols_many_regressors", _coefficients("fit", "'log_wage' AS y, ", len(_MANY_X) + 1), _LINE, _WAGES, _MANY_ROWS,
       _elimination("fit", "many", [], _MANY_X, "n"), _terms(_MANY_X))
oracle("oaxaca_detail", _gap_parts("'log_wage' AS y, ", "gap", len(_MANY) + 1, True), _LINE, _WAGES, _MANY_ROWS,
       _elimination("side", "many", ["female"], _MANY, "n"), _both_sides("gap", "side", [], "female", len(_MANY) + 1), _terms(_MANY))

# The wage models: regular employees by the cascading status, log wages and influence variables.
_CORE = ["Age", "age_sq", "dummy_primary_below", "dummy_middle", "dummy_secondary", "dummy_higher_secondary", "dummy_graduate_diploma",
         "dummy_postgraduate", "dummy_urban", "dummy_married"]
_EMPLOYEES = """
employees AS (SELECT CASE WHEN wage_regular_salaried > 0 THEN ln(wage_regular_salaried) END AS log_wage, Weight, Age, Age * Age AS age_sq,
    CAST(coalesce(CAST(General_education AS INT) = 5, FALSE) AS INT) AS dummy_primary_below, CAST(coalesce(CAST(General_education AS INT) = 7, FALSE) AS INT) AS dummy_middle,
    CAST(coalesce(CAST(General_education AS INT) = 8, FALSE) AS INT) AS dummy_secondary, CAST(coalesce(CAST(General_education AS INT) = 10, FALSE) AS INT) AS dummy_higher_secondary,
    CAST(coalesce(CAST(General_education AS INT) IN (11, 12), FALSE) AS INT) AS dummy_graduate_diploma,
    CAST(coalesce(CAST(General_education AS INT) = 13, FALSE) AS INT) AS dummy_postgraduate,
    CASE Sector_code WHEN '2' THEN 1 WHEN '1' THEN 0 END AS dummy_urban, CASE Marital_status WHEN '2' THEN 1 WHEN '1' THEN 0 END AS dummy_married,
    CASE Gender_code WHEN '1' THEN 1 WHEN '2' THEN 0 END AS dummy_male, CASE Gender_code WHEN '2' THEN 1 WHEN '1' THEN 0 END AS g_gender,
    CASE WHEN Social_group IN ('1', '2') THEN 1 WHEN Social_group = '9' THEN 0 END AS g_scst,
    CASE WHEN Social_group IN ('1', '2') AND Gender_code = '2' THEN 1 WHEN Social_group = '9' AND Gender_code = '1' THEN 0 END AS g_men,
    CASE WHEN Social_group IN ('1', '2') AND Gender_code = '2' THEN 1 WHEN Social_group = '9' AND Gender_code = '2' THEN 0 END AS g_women
  FROM prepared WHERE CASE WHEN Principal_status IN (11, 12, 21, 31, 41, 51) THEN Principal_status ELSE Subsidiary_status END = 31)"""
_INFLUENCE = ", ".join(f"q{i} - CASE WHEN coalesce(log_wage <= q{i}, FALSE) THEN 1 ELSE 0 END / ({p}e0 * (1 - {p}e0)) AS rif{i}" for p, i in zip(_P3, (25, 75, 90)))
_MODEL_ROWS = f"""
quantiles AS (SELECT {_Q3}),
influence AS (SELECT employees.*, {_INFLUENCE} FROM employees, quantiles WHERE Age IS NOT NULL AND dummy_urban IS NOT NULL AND dummy_married IS NOT NULL
  AND dummy_male IS NOT NULL)"""
_COMPARED = [  # (name, side, indicator, male dummy, weighting of the wage models, weighting of the others, twofold)
    ("gender", "g_gender", False, True, ("unweighted", "weighted"), "weighted", True),
    ("scst_vs_others", "g_scst", True, True, ("unweighted",), "unweighted", True),
    ("scst_women_vs_general_men", "g_men", True, False, ("unweighted",), "unweighted", False),
    ("scst_women_vs_general_women", "g_women", True, False, ("unweighted",), "unweighted", False)]


def _model_rows(name: str, models) -> str:
    """Rows of every (comparison, weighting, y): columns that a model does not have are zero, and so left out by the elimination."""
    parts = []
    for comparison, side, weighting, y, indicator, male in models:
        parts.append(f"""SELECT '{comparison}' AS comparison, '{weighting}' AS weighting, '{y}' AS dependent, {side} AS side, {y} AS y,
  {'Weight' if weighting == 'weighted' else '1.0e0'} AS w, {f'1 - {side}' if indicator else '0'} AS indicator, {', '.join(_CORE)},
  {'dummy_male' if male else '0'} AS dummy_male FROM influence WHERE {side} IS NOT NULL AND {y} IS NOT NULL""")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_RIFS = ("rif25", "rif75", "rif90")
_REGRESSED = [(c, side, weighting, y, indicator, male) for c, side, indicator, male, wages, others, _ in _COMPARED
              for y, kinds in (("log_wage", wages), *[(r, (others,)) for r in _RIFS]) for weighting in kinds]
_REG_X = ["indicator", *_CORE, "dummy_male"]
_HAS = " OR ".join(f"comparison = '{c}'" for c, _, indicator, *_ in _COMPARED if indicator)
_MEN = " OR ".join(f"comparison = '{c}'" for c, _, _, male, *_ in _COMPARED if male)
_MODEL_KEYS = ["comparison", "weighting", "dependent"]
_WAGE_INPUT = (_prepared("video"), _EMPLOYEES, _percentiles("log_wage", "employees", _P3), _MODEL_ROWS)
oracle("wage_regressions",
       _coefficients("fit", "comparison, weighting, dependent AS y, ", len(_REG_X) + 1)
       + f" WHERE (term <> 'indicator' OR {_HAS}) AND (term <> 'dummy_male' OR {_MEN})",
       *_WAGE_INPUT, _model_rows("models", _REGRESSED), _elimination("fit", "models", _MODEL_KEYS, _REG_X, "sw"), _terms(_REG_X))
_SPLIT = [(c, side, "weighted", y, False, False) for c, side, *_ in _COMPARED for y in ("log_wage", *_RIFS)]
_TWOFOLD = " OR ".join(f"comparison = '{c}'" for c, *_, twofold in _COMPARED if twofold)
_N = len(_CORE) + 1
oracle("wage_decompositions",
       _gap_parts("comparison, 'threefold' AS split, dependent AS y, ", "three", _N, True) + " UNION ALL "
       + _gap_parts("comparison, 'twofold' AS split, dependent AS y, ", "two", _N, False, True),
       *_WAGE_INPUT, _model_rows("models", _SPLIT),
       _elimination("side_fit", "models", [*_MODEL_KEYS, "side"], _CORE, "sw"),
       f"wage_models AS (SELECT * FROM models WHERE dependent = 'log_wage' AND ({_TWOFOLD}))",
       _elimination("star", "wage_models", _MODEL_KEYS, [*_CORE, "side"], "sw"),
       _both_sides("three", "side_fit", _MODEL_KEYS, "side", _N), _both_sides("two", "side_fit", _MODEL_KEYS, "side", _N, "star"), _terms(_CORE))

# --- reconciliation ------------------------------------------------------------------------------


def _status_cells():
    """Annual and historical cells of the two status sheets, and the historical ones in print."""
    specs = [s for s in ct.CATALOGUE if s.sheet in ("employment_status", "employment_social_group")]
    out = []
    for mode, name in (("annual", "annual_cells"), ("video", "video_cells")):
        chain = _catalogue(mode, specs)
        out.append(f"{name} AS (WITH {', '.join(c.strip() for c in chain)} SELECT * FROM cells)")
    out.append("""published AS (SELECT sheet, Age_group, Sector, group_label, code, gender,
      CASE WHEN group_label IS NULL THEN printf('%.2f', value) ELSE printf('%.1f', value) END AS printed,
      CASE WHEN group_label IS NULL THEN 2 ELSE 1 END AS decimals FROM video_cells WHERE value IS NOT NULL)""")
    out.append("""compared AS (SELECT p.*, c.value, CASE WHEN c.code IS NULL THEN 0 ELSE 1 END AS match_count,
      coalesce(CASE WHEN decimals = 2 THEN printf('%.2f', c.value) ELSE printf('%.1f', c.value) END = printed, FALSE) AS matches,
      coalesce(abs(c.value - CAST(printed AS DOUBLE)) < 0.5 * 10.0e0 ** -decimals, FALSE) AS within
      FROM published p LEFT JOIN annual_cells c ON p.sheet = c.sheet AND p.Age_group = c.Age_group AND p.Sector = c.Sector
        AND p.group_label IS NOT DISTINCT FROM c.group_label AND p.code = c.code AND p.gender = c.gender)""")
    return out


oracle("compare_printed", f"""
SELECT sheet, Age_group, Sector, group_label, code, gender, printed, {R('value')} AS value, CAST(match_count AS BIGINT) AS match_count, matches
FROM compared""", *_status_cells())
oracle("compare_tolerance", """
SELECT sheet, Sector, count(*) AS cells, count(*) FILTER (WHERE within) AS within FROM compared GROUP BY 1, 2""", *_status_cells())
oracle("comparison_summary", """
SELECT count(*) AS cells_checked, count(*) FILTER (WHERE matches) AS cells_matched,
  count(*) FILTER (WHERE match_count <> 1) AS cells_not_found_once FROM compared""", *_status_cells())


def _printed(condition: str) -> str:
    total = f"coalesce(sum(l_partkey) FILTER (WHERE {condition}), 0)"
    return f"CAST(count(*) FILTER (WHERE {condition}) AS VARCHAR) || '.' || lpad(CAST({total} % 100 AS VARCHAR), 2, '0')"


_NINE = [(s, g) for s in ("Rural", "Urban", "Rural + Urban") for g in ("Male", "Female", "Persons")]
oracle("extract_division_rows", " UNION ALL ".join(
    f"SELECT s_nationkey AS page_no, CAST(1 + l_partkey % 9 AS VARCHAR) AS code, '{s}' AS Sector, '{g}' AS gender, "
    f"{_printed(f'l_linenumber = {i}')} AS printed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
    for i, (s, g) in enumerate(_NINE, 1)))
_SECTOR_CASE = "CASE l_linenumber % 3 WHEN 0 THEN 'Rural' WHEN 1 THEN 'Urban' ELSE 'Rural + Urban' END"
_GENDER_CASE = "CASE l_returnflag WHEN 'A' THEN 'Male' WHEN 'N' THEN 'Female' ELSE 'Persons' END"
_GROUP_CASE = "CASE l_partkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'SC' ELSE 'OBC' END"
oracle("extract_group_rows", " UNION ALL ".join(
    f"SELECT s_nationkey AS page_no, {_GROUP_CASE} AS group_label, {_SECTOR_CASE} AS Sector, {_GENDER_CASE} AS gender, "
    f"'{code}' AS code, {_printed(f'l_orderkey % 6 = {i}')} AS printed "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4"
    for i, code in enumerate(("1", "2", "self", "3", "4", "total"))))
oracle("extract_log_rows", " UNION ALL ".join(
    f"SELECT CAST(s_nationkey AS VARCHAR) AS document, 'NCO_division' AS sheet, '15+' AS Age_group, 'Urban' AS Sector, "
    f"CAST(1 + l_partkey % 9 AS VARCHAR) AS code, '{g}' AS gender, {_printed(f'l_linenumber = {i}')} AS printed "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 5"
    for i, g in enumerate(("Male", "Female", "Persons"), 1)))

_LOG_NAME = "CASE l_returnflag WHEN 'A' THEN 'Male' WHEN 'N' THEN 'Female' ELSE 'Total' END"
_LOG_LINES = f"""log_lines AS (SELECT s_nationkey AS k, {_LOG_NAME} AS name, {", ".join(f"""
  count(*) FILTER (WHERE l_linenumber = {i}) || '.' || lpad(CAST(coalesce(sum(l_partkey) FILTER (WHERE l_linenumber = {i}), 0) % 100 AS VARCHAR), 2, '0') AS n{i}"""
  for i in range(1, 5))}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
log_read AS (SELECT * FROM log_lines WHERE NOT (name = 'Total' AND k % 3 = 0)),
logs AS (SELECT DISTINCT s_nationkey AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
named_logs AS (SELECT k, CASE k % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'SC' WHEN 2 THEN 'OBC' END AS group_label FROM logs)"""
oracle("log_commands_read", """
SELECT CAST(k AS VARCHAR) AS document, 'tab Gender Broad_Status [iw=weight] if Sector==1 & Age>=15 & Social_Group==' || (1 + k % 4) || ', nof row' AS command,
  'employment_social_group' AS sheet, '15+' AS Age_group, 'Rural' AS Sector, group_label,
  CAST((SELECT count(*) FROM log_read r WHERE r.k = l.k) AS INT) AS lines, 3 AS expected,
  (SELECT count(*) FROM log_read r WHERE r.k = l.k) = 3 AND group_label IS NOT NULL AS readable
FROM named_logs l""", _LOG_LINES)
oracle("log_status_cells", """
SELECT CAST(l.k AS VARCHAR) AS document, 'Rural' AS Sector, group_label, code, CASE g.name WHEN 'Total' THEN 'Persons' ELSE g.name END AS gender,
  CASE code WHEN '1' THEN n1 WHEN '2' THEN n2 WHEN '3' THEN n3 ELSE n4 END AS printed
FROM named_logs l CROSS JOIN (VALUES ('Male'), ('Female'), ('Total')) g(name) CROSS JOIN (VALUES ('1'), ('2'), ('3'), ('4')) c(code)
LEFT JOIN log_read r ON r.k = l.k AND r.name = g.name""", _LOG_LINES)

# --- files ---------------------------------------------------------------------------------------

oracle("coded_csv_read", "SELECT qtr_perv1, b1q1_perv1, b1q15_perv1, b4q1_perv1, b4q6_perv1, b5pt1q5_perv1, b5pt2q3_perv1, b6q9_perv1 FROM persons", _FILES)
oracle("coded_parquet_read", "SELECT qtr_hhv1, b1q1_hhv1, b1q15_hhv1, state_hhv1, mult_hhv1, b3q3_hhv1, b3q4_hhv1, b3q5pt6_hhv1 FROM households", _FILES)
oracle("page_texts_read", "SELECT page_id AS page_no, md5(html) AS text_md5 FROM pages")
oracle("report_written", "SELECT sheet, count(*) AS rows, TRUE AS in_order FROM cells GROUP BY sheet", *_catalogue("annual"))
oracle("microdata_written", f"SELECT PID, HHID, Status_used, NIC_broad, {R('Weight')} AS Weight FROM prepared", _prepared())
oracle("label_metadata", """
SELECT CASE Social_group WHEN '1' THEN 'ST' WHEN '2' THEN 'SC' WHEN '3' THEN 'OBC' WHEN '9' THEN 'Others' END AS label, count(*) AS n
FROM prepared GROUP BY 1""", _prepared())
oracle("listed_social_groups", f"SELECT g_scst AS dummy_scst, count(*) AS n, {R('sum(Weight)', 5)} AS weighted FROM employees WHERE g_scst IS NOT NULL GROUP BY 1",
       _prepared("video"), _EMPLOYEES)
