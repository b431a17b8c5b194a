"""Survey-shaped views of the driver tables.

``coded_files`` derives a coded person file and a coded household file: an order with line items is a
household, its distinct line numbers are persons.  ``line_view`` is a flatter view in which every line
item is a respondent.  Both grow with the tables they read.

The expressions are plain SQL that more than one engine understands, so a checker can build the same
inputs and then compute the results in its own way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.functions import status, weights

# Order keys outgrow a five-digit unit number, so this view has a wider one.
KEY_PARTS = tuple(replace(p, width=12) if p.prefix == "b1q1" else p for p in cb.KEY_PARTS)


def _pick(values: str, index: str) -> str:
    """Entry ``index`` (taken round) of a list of one- or two-character codes."""
    codes = values.split()
    return f"trim(substring('{''.join(c.rjust(2) for c in codes)}', CAST({index} % {len(codes)} * 2 + 1 AS INT), 2))"


def _text(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _unit(start: int, length: int) -> str:
    return f"substring(lpad(CAST(o_orderkey AS STRING), 16, '0'), {start}, {length})"


# Columns that both files carry, over orders and customer.
SHARED = {
    "qtr": "concat('Q', CAST(quarter(o_orderdate) AS STRING))",
    "visit": "'V1'",
    "b1q3": "CASE WHEN o_custkey % 3 = 0 THEN '2' ELSE '1' END",
    "b1q1": _unit(1, 12),
    "b1q13": _unit(13, 1),
    "b1q14": _unit(14, 1),
    "b1q15": _unit(15, 2),
    "state": "lpad(CAST(1 + c_nationkey AS STRING), 2, '0')",
    "nss": _text("1 + o_orderkey % 2"),
    "nsc": _text("1 + o_custkey % 2"),
    "mult": _text("CAST(floor(o_totalprice) AS BIGINT)"),
    "no_qtr": _text("1 + o_orderkey % 4"),
}

HOUSEHOLD = {
    **{f"{name}_hhv1": text for name, text in SHARED.items()},
    "b3q1_hhv1": _text("1 + o_custkey % 9"),
    "b3q2_hhv1": _text("1 + o_orderkey % 4"),
    "b3q3_hhv1": _pick("1 2 3 4 5 6 7 9", "c_nationkey"),
    "b3q4_hhv1": "CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'AUTOMOBILE' THEN '2' "
                 "WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '9' END",
    "b3q5pt6_hhv1": _text("c_acctbal * 8"),
}

_WORK = "('11', '12', '21', '31', '41', '51')"
_NIC = ("concat(lpad(" + _pick("1 2 3 5 8 9 10 15 20 25 33 35 36 39 41 42 43 45 46 47 49 50 53 55 56 58 64 85 99",
                               "({0} + l_linenumber)") + ", 2, '0'), lpad(CAST({0} % 1000 AS STRING), 3, '0'))")

# Codes that many other columns depend on, over the deduplicated line items.
PERSON_STAGE = {
    "principal": _pick("11 11 11 12 21 21 31 31 31 31 41 51 81 81 91 92 93 94 95 97 99 31", "(pk + sk)"),
    "subsidiary": f"CASE WHEN (pk + l_orderkey) % 5 = 0 THEN {_pick('11 12 21 31 41 51', 'sk')} END",
    "years": "(pk * 7 + l_linenumber) % 90",
}


def _if_principal(value: str) -> str:
    return f"CASE WHEN principal IN {_WORK} THEN {value} END"


def _if_subsidiary(value: str) -> str:
    return f"CASE WHEN subsidiary IS NOT NULL THEN {value} END"


PERSON = {
    **{f"{name.upper() if name in ('nss', 'nsc') else name}_perv1": text for name, text in SHARED.items()},
    "b4q1_perv1": "lpad(CAST(l_linenumber AS STRING), 2, '0')",
    "b4q5_perv1": "CASE WHEN pk % 50 = 0 THEN '3' WHEN flag = 'A' THEN '1' WHEN flag = 'N' THEN '2' "
                  "WHEN pk % 2 = 0 THEN '1' ELSE '2' END",
    "b4q6_perv1": _text("years"),
    "b4q7_perv1": _text("1 + pk % 4"),
    "b4q8_perv1": _pick("1 5 7 8 10 11 12 13", "(pk + sk)"),
    "b4q9_perv1": _text("1 + sk % 3"),
    "b4q11_perv1": f"CASE WHEN years < 30 THEN {_pick('1 5 11 15 16 21 24 25 26 27 28 31 32 33 43', 'sk')} END",
    "b4q12_perv1": f"CASE WHEN years BETWEEN 12 AND 59 THEN {_text('1 + pk % 6')} END",
    "b4pt1q4_perv1": f"CASE WHEN pk % 6 = 0 THEN {_text('1 + sk % 22')} END",
    "b4pt1q5_perv1": f"CASE WHEN pk % 6 = 0 THEN {_text('1 + sk % 6')} END",
    "b4pt1q6_perv1": f"CASE WHEN pk % 6 = 0 THEN {_text('1 + sk % 3')} END",
    "b5pt1q3_perv1": "principal",
    "b5pt2q3_perv1": "subsidiary",
    "b5pt1q5_perv1": _if_principal(_NIC.format("sk")),
    "b5pt2q5_perv1": _if_subsidiary(_NIC.format("pk")),
    "b5pt1q6_perv1": _if_principal(_text("100 + pk % 899")),
    "b5pt2q6_perv1": _if_subsidiary(_text("100 + sk % 899")),
    "b5pt1q13_perv1": f"CASE WHEN principal IN ('31', '41', '51') AND pk % 7 <> 0 THEN {_text('1 + sk % 9')} END",
    "b5pt2q12_perv1": f"CASE WHEN subsidiary IN ('31', '41', '51') THEN {_text('1 + pk % 9')} END",
    "b5pt3q6_perv1": _if_principal(_text("1 + l_orderkey % 5")),
    "b5pt3q7_perv1": _if_subsidiary(_text("1 + sk % 5")),
    "b5pt3q8_perv1": f"CASE WHEN principal = '81' THEN {_text('1 + pk % 7')} END",
    "b5pt3q9_perv1": f"CASE WHEN principal = '81' AND subsidiary IS NULL THEN {_text('1 + sk % 5')} END",
    "b5pt3q11_perv1": f"CASE WHEN principal NOT IN {_WORK} AND pk % 2 = 0 THEN {_text('1 + pk % 8')} END",
    "b6q9_perv1": f"CASE WHEN principal = '31' AND pk % 31 <> 0 THEN "
                  f"CASE WHEN pk % 97 = 0 THEN '0' ELSE {_text('CAST(floor(price) AS BIGINT)')} END END",
}

# One row per (order, line number): the pair repeats in the driver table.
PERSON_BASE = ("SELECT l_orderkey, l_linenumber, max(l_partkey) AS pk, max(l_suppkey) AS sk, "
               "max(l_extendedprice) AS price, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flag() -> Column:
    """Largest return flag of a group as a number: the maximum of a text would need a sorting aggregate."""
    return F.max(F.ascii("l_returnflag")).alias("flag_code")


def _named_flag(base: DataFrame) -> DataFrame:
    return base.withColumn("flag", F.char("flag_code")).drop("flag_code")


def coded_files(spark: SparkSession, sf_dir: str, matched_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(persons, households)`` as coded text; optionally with the orders that have no line item."""
    lineitem, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    units = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    base = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("pk"), F.max("l_suppkey").alias("sk"),
        F.max("l_extendedprice").alias("price"), _flag())
    base = _named_flag(base).select("*", *[F.expr(text).alias(name) for name, text in PERSON_STAGE.items()])
    persons = base.join(units, F.col("l_orderkey") == F.col("o_orderkey"))
    if matched_only:
        units = units.join(lineitem.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"),
                           "left_semi")
    return (persons.select(*[F.expr(text).alias(name) for name, text in PERSON.items()]),
            units.select(*[F.expr(text).alias(name) for name, text in HOUSEHOLD.items()]))


# Every household is visited again once, with a visit number, a multiplier and a column of its own.
REVISIT_SHARED = {**SHARED, "visit": "concat('V', CAST(2 + o_orderkey % 3 AS STRING))", "mult": _text("1 + CAST(floor(o_totalprice) AS BIGINT)"),
                  "nss": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 2 AS STRING) END"}
REVISIT_HOUSEHOLD = {
    **{f"{name}_hhrv": text for name, text in REVISIT_SHARED.items()},
    "b3q4_hhrv": HOUSEHOLD["b3q4_hhv1"],
    "b3q9_hhrv": _text("o_orderkey % 11"),
}
# Line items as they are: pairs of order and line number repeat, as keys of a revisit file may.
REVISIT_PERSON_BASE = ("SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS price, "
                       "l_returnflag AS flag FROM lineitem")
REVISIT_PERSON = {
    **{f"{name.upper() if name in ('nss', 'nsc') else name}_perrv": text for name, text in REVISIT_SHARED.items()},
    "b4q1_perrv": PERSON["b4q1_perv1"],
    "b4q5_perrv": PERSON["b4q5_perv1"],
    "b4q6_perrv": _text("(pk * 7 + l_linenumber) % 90"),
}


def visit_files(spark: SparkSession, sf_dir: str, repeats: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Households and persons of first visits and revisits; without ``repeats`` persons of revisits are distinct by key."""
    persons, households = coded_files(spark, sf_dir, matched_only=False)
    lineitem, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    units = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    base = lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
                           F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    if not repeats:
        base = _named_flag(base.withColumnRenamed("flag", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(
            *[F.max(c).alias(c) for c in ("pk", "sk", "price")], _flag()))
    again = base.join(units, F.col("l_orderkey") == F.col("o_orderkey"))
    return ({"first": households, "revisit": units.select(*[F.expr(text).alias(name) for name, text in REVISIT_HOUSEHOLD.items()])},
            {"first": persons, "revisit": again.select(*[F.expr(text).alias(name) for name, text in REVISIT_PERSON.items()])})


LINE = {
    "Age": ("CAST(p_size AS DOUBLE)", "part"),
    "Sector_code": ("CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END", None),
    "Gender_original": ("CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END", None),
    "Multiplier": ("l_quantity", None),
    "NSS": ("CAST(1 AS DOUBLE)", None),
    "NSC": ("CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) WHEN o_orderstatus = 'O' THEN CAST(2 AS DOUBLE) END",
            "orders"),
    "Contributing_quarters": ("CAST(1 + l_linenumber % 4 AS DOUBLE)", None),
    "Principal_status": ("CASE o_orderpriority WHEN '1-URGENT' THEN 11 WHEN '2-HIGH' THEN 31 WHEN '3-MEDIUM' THEN 81 "
                         "WHEN '4-NOT SPECIFIED' THEN 92 ELSE 41 END", "orders"),
    "Subsidiary_status": ("CASE p_type WHEN 'PROMO' THEN 21 WHEN 'ECONOMY' THEN 51 END", "part"),
    "Security_principal": ("CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(1 + l_suppkey % 9 AS STRING) END", None),
    "Security_subsidiary": ("CAST(1 + l_partkey % 9 AS STRING)", None),
    "Segment": ("c_mktsegment", "customer"),
    "State": ("n_name", "nation"),
    "Brand": ("p_brand", "part"),
    "Type": ("p_type", "part"),
    "Spending": ("c_acctbal", "customer"),
    "Marital_status": ("CAST(1 + l_suppkey % 4 AS STRING)", None),
    "General_education": ("CAST(1 + l_partkey % 13 AS INT)", None),
    "Wage": ("CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 0.0e0 ELSE l_extendedprice END", None),
    "Line": ("l_linenumber", None),
    "Discount": ("l_discount", None),
    "Order": ("l_orderkey", None),
}
_NEEDS = {"part": ("part",), "orders": ("orders",), "customer": ("orders", "customer"),
          "nation": ("orders", "customer", "nation"), None: ()}
_ON = {"part": "l_partkey = p_partkey", "orders": "l_orderkey = o_orderkey", "customer": "o_custkey = c_custkey",
       "nation": "c_nationkey = n_nationkey"}


def line_view(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The chosen survey columns of every line item, joining only the tables that they need.

    Orders meet customers and nations first, so line items are shuffled once for each key of their own.  Columns of the other tables
    are made before the joins, so that codes travel and not the texts they are made from.
    """
    needed = {t for c in columns for t in _NEEDS[LINE[c][1]]}
    own = {t: [c for c in columns if LINE[c][1] == t] for t in _ON}

    def side(name: str, *keys: str) -> DataFrame:
        return table(spark, sf_dir, name).select(*keys, *[F.expr(LINE[c][0]).alias(c) for c in own[name]])

    rows = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        rows = rows.join(side("part", "p_partkey"), F.expr(_ON["part"]))
    if "orders" in needed:
        units = side("orders", "o_orderkey", "o_custkey")
        if "customer" in needed:
            units = units.join(side("customer", "c_custkey", "c_nationkey"), F.expr(_ON["customer"]))
        if "nation" in needed:
            units = units.join(side("nation", "n_nationkey"), F.expr(_ON["nation"]))
        rows = rows.join(units, F.expr(_ON["orders"]))
    return rows.select(*[(F.expr(LINE[c][0]) if LINE[c][1] is None else F.col(c)).alias(c) for c in columns])


_WEIGHT = ("Multiplier", "NSS", "NSC", "Contributing_quarters")


def respondents(spark: SparkSession, sf_dir: str, *columns: str, flags: bool = False) -> DataFrame:
    """Line view with the annual weight and report gender, and the activity flags on request."""
    wanted = dict.fromkeys([*_WEIGHT, "Gender_original", *columns])
    if flags:
        wanted |= dict.fromkeys(["Principal_status", "Subsidiary_status"])
    rows = line_view(spark, sf_dir, list(wanted))
    rows = rows.withColumn("Weight", weights.annual_weight()).withColumn(
        "Gender", status.gender_name(status.report_gender_code()))
    if flags:
        rows = rows.withColumns(status.activity_flags())
        rows = rows.withColumn("Status_used", status.selected_job("Principal_status", "Subsidiary_status"))
        rows = rows.withColumn("Broad_status", status.broad_status("Status_used"))
    return rows
