"""Invented survey rows.  Nobody in here exists."""

from surveyspark import codebook as cb
from surveyspark.sources.coded import household_columns, person_columns

AGREE = dict(state="09", nss="1", nsc="2", mult="12345", no_qtr="4")


def key(suffix, household, sector="1", quarter="Q1", visit="V1", fsu="10001"):
    values = (quarter, visit, sector, fsu, "1", "2", household)
    return {f"{p.prefix}_{suffix}": v for p, v in zip(cb.KEY_PARTS, values)}


def household(number, sector="1", **over):
    agree = {**AGREE, **over.pop("agree", {})}
    row = dict.fromkeys(household_columns())
    row |= key("hhv1", number, sector)
    row |= {f"{k}_hhv1": v for k, v in agree.items()}
    row |= {"b3q1_hhv1": "4", "b3q2_hhv1": "1", "b3q3_hhv1": "1", "b3q4_hhv1": "1", "b3q5pt6_hhv1": "9999"}
    return {**row, **over}


def person(number, serial, sector="1", **over):
    agree = {**AGREE, **over.pop("agree", {})}
    row = dict.fromkeys(person_columns(wages=True))
    row |= key("perv1", number, sector)
    row |= {f"{k.upper() if k in ('nss', 'nsc') else k}_perv1": v for k, v in agree.items()}
    row |= {"b4q1_perv1": serial, "b4q5_perv1": "1", "b4q6_perv1": "30", "b4q7_perv1": "2", "b4q8_perv1": "8",
            "b4q9_perv1": "1", "b5pt1q3_perv1": "92"}
    return {**row, **over}


def job(principal=None, subsidiary=None, nic="01110", nco="611", **over):
    out = {}
    if principal:
        out |= {"b5pt1q3_perv1": principal}
        if int(principal) in cb.WORK_CODES:
            out |= {"b5pt1q5_perv1": nic, "b5pt1q6_perv1": nco, "b5pt3q6_perv1": "5"}
    if subsidiary:
        out |= {"b5pt2q3_perv1": subsidiary, "b5pt2q5_perv1": "47110", "b5pt2q6_perv1": "522", "b5pt3q7_perv1": "2"}
    return {**out, **over}


def survey():
    """Households and persons that meet every special rule once."""
    equal = {"nss": "3", "nsc": "3", "no_qtr": "1", "mult": "777"}
    three = {"nss": "1", "nsc": "3", "no_qtr": "3", "mult": "100001"}
    households = [
        household("01"),
        household("02", b3q4_hhv1=None, b3q5pt6_hhv1="9999.5"),
        household("03", sector="2", agree=equal, b3q4_hhv1="2", b3q3_hhv1="2", b3q5pt6_hhv1="10000"),
        household("04", sector="2", agree=three, b3q4_hhv1="9", b3q5pt6_hhv1="-1"),
        household("05", b3q4_hhv1="3", b3q5pt6_hhv1="50000"),
        household("06", b3q4_hhv1="9", b3q5pt6_hhv1=None),
    ]
    divisions = "01 03 05 09 10 33 35 39 41 43 45 47 49 53 55 56 58 99".split()
    persons = [
        person("01", "01", **job("81", "21", b5pt3q8_perv1="1"), b4q12_perv1="1", b4pt1q4_perv1="07",
               b4pt1q5_perv1="2", b4pt1q6_perv1="3"),
        person("01", "02", **job("81", b5pt3q8_perv1="2", b5pt3q9_perv1="3"), b4q5_perv1="2", b4q6_perv1="15",
               b4q11_perv1="24", b4q12_perv1="6"),
        person("01", "03", **job("31", "41", b5pt1q13_perv1=None, b5pt2q12_perv1="7"), b4q6_perv1="59", b6q9_perv1="12000"),
        person("01", "04", **job("92", "11"), b4q5_perv1="2", b4q6_perv1="60"),
        person("02", "01", **job("11"), b4q5_perv1="3", b4q6_perv1="29", b4q11_perv1="16"),
        person("02", "02", **job("31", b5pt1q13_perv1="8"), b4q7_perv1="3", b4q6_perv1="14", b6q9_perv1="0"),
        person("03", "01", sector="2", agree=equal, **job("41", b5pt1q13_perv1="NA"), b4q6_perv1="45"),
        person("03", "02", sector="2", agree=equal, **job("97", b5pt3q11_perv1="2"), b4q6_perv1="30"),
        person("04", "01", sector="2", agree=three, **job("31", b5pt1q13_perv1="1"), b4q5_perv1="2", b6q9_perv1="22000"),
        person("06", "01", **job("95"), b4q5_perv1="2", b4q6_perv1="70", b4q11_perv1=None),
    ]
    for i, division in enumerate(divisions):
        status = ("11", "21", "31", "51")[i % 4]
        wage = str(9000 + 500 * i) if status == "31" else None
        persons.append(person("05", f"{i + 1:02d}", **job(status, nic=f"{division}000", nco=f"{1 + i % 9}11"),
                              b4q5_perv1=str(1 + i % 2), b4q6_perv1=str(20 + 2 * i), b4q12_perv1=str(1 + i % 6),
                              b6q9_perv1=wage))
    return persons, households


def frames(spark, rows=None):
    persons, households = rows or survey()
    p_columns, h_columns = person_columns(wages=True), household_columns()
    return (spark.createDataFrame([tuple(r[c] for c in p_columns) for r in persons], ", ".join(f"{c} string" for c in p_columns)),
            spark.createDataFrame([tuple(r[c] for c in h_columns) for r in households], ", ".join(f"{c} string" for c in h_columns)))


def write_csv(folder, rows=None, bom=True):
    persons, households = rows or survey()
    for name, columns, table in (("perv1", person_columns(wages=True), persons), ("hhv1", household_columns(), households)):
        lines = [",".join(["extra", *columns])]
        lines += [",".join(["x", *[("" if r[c] is None else f" {r[c]} ") for c in columns]]) for r in table]
        text = ("﻿" if bom else "") + "\r\n".join(lines) + "\r\n"
        (folder / f"{name}.csv").write_bytes(text.encode("utf-8"))
