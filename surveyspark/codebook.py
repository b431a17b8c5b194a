"""The survey's fixed values: column names, code sets, bands and labels.

Nothing here computes anything.  A different survey is a different codebook.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KeyPart:
    """One fixed-width part of the household key."""

    prefix: str
    name: str
    width: int
    pattern: str


@dataclass(frozen=True)
class AgeGroup:
    """Inclusive age range; ``upper=None`` is open-ended.  Groups may overlap."""

    name: str
    lower: int
    upper: int | None = None


@dataclass(frozen=True)
class Band:
    """Inclusive range of integer codes that share one band code."""

    lower: int
    upper: int
    code: str


# ---------------------------------------------------------------------------
# Names, codes and labels given by the survey's own files.
# ---------------------------------------------------------------------------

KEY_PARTS = (
    KeyPart("qtr", "Quarter", 2, "Q[1-4]"),
    KeyPart("visit", "Visit", 2, "V1"),
    KeyPart("b1q3", "Sector_code", 1, "[0-9]+"),
    KeyPart("b1q1", "FSU", 5, "[0-9]+"),
    KeyPart("b1q13", "Hamlet", 1, "[0-9]+"),
    KeyPart("b1q14", "Second_stage_stratum", 1, "[0-9]+"),
    KeyPart("b1q15", "Household_number", 2, "[0-9]+"),
)

PERSON_FIELDS = {
    "state_perv1": "State_code",
    "b4q1_perv1": "Person_number",
    "b4q5_perv1": "Gender_original",
    "b4q6_perv1": "Age",
    "b4q7_perv1": "Marital_status",
    "b4q8_perv1": "General_education",
    "b4q9_perv1": "Technical_education",
    "b4q11_perv1": "Attendance_code",
    "b4q12_perv1": "Training_code",
    "b4pt1q4_perv1": "Training_field",
    "b4pt1q5_perv1": "Training_duration",
    "b4pt1q6_perv1": "Training_type",
    "b5pt1q3_perv1": "Principal_status",
    "b5pt2q3_perv1": "Subsidiary_status",
    "b5pt1q5_perv1": "NIC_principal",
    "b5pt2q5_perv1": "NIC_subsidiary",
    "b5pt1q6_perv1": "NCO_principal",
    "b5pt2q6_perv1": "NCO_subsidiary",
    "b5pt1q13_perv1": "Security_principal",
    "b5pt2q12_perv1": "Security_subsidiary",
    "b5pt3q6_perv1": "Economic_months_principal",
    "b5pt3q7_perv1": "Economic_months_subsidiary",
    "b5pt3q8_perv1": "Efforts_to_find_work",
    "b5pt3q9_perv1": "Unemployment_duration",
    "b5pt3q11_perv1": "Reason_not_working",
    "NSS_perv1": "NSS",
    "NSC_perv1": "NSC",
    "mult_perv1": "Multiplier",
    "no_qtr_perv1": "Contributing_quarters",
}

HOUSEHOLD_FIELDS = {
    "b3q1_hhv1": "Household_size",
    "b3q2_hhv1": "Household_type",
    "b3q3_hhv1": "Religion",
    "b3q4_hhv1": "Social_group",
    "b3q5pt6_hhv1": "Household_monthly_spending",
}

# Used by the wage models only.
WAGE_FIELDS = {"b6q9_perv1": "wage_regular_salaried"}

# Columns that both files carry and that must agree (person side, household side).
AGREEMENT_FIELDS = (
    ("state_perv1", "state_hhv1"),
    ("NSS_perv1", "nss_hhv1"),
    ("NSC_perv1", "nsc_hhv1"),
    ("mult_perv1", "mult_hhv1"),
    ("no_qtr_perv1", "no_qtr_hhv1"),
)

NUMERIC_FIELDS = (
    "Age", "Household_size", "Household_monthly_spending", "NSS", "NSC",
    "Multiplier", "Contributing_quarters", "Principal_status", "Subsidiary_status",
)

AGE_GROUPS = {
    "All ages": AgeGroup("All ages", 0),
    "15+": AgeGroup("15+", 15),
    "15-29": AgeGroup("15-29", 15, 29),
    "15-59": AgeGroup("15-59", 15, 59),
}
SECTORS = {"Rural": "1", "Urban": "2"}
POOLED_SECTOR = "Rural + Urban"
GENDERS = ("Male", "Female", "Persons")

WORK_CODES = (11, 12, 21, 31, 41, 51)
EMPLOYEE_CODES = (31, 41, 51)
SEEKING_CODE = 81
OUTSIDE_CODES = (91, 92, 93, 94, 95, 97, 99)
BROAD_STATUS = {11: "1", 12: "1", 21: "2", 31: "3", 41: "4", 51: "4"}

NIC_BROAD_BANDS = (
    Band(1, 3, "1"), Band(5, 9, "2"), Band(10, 33, "3"), Band(35, 39, "4"), Band(41, 43, "5"),
    Band(45, 47, "7"), Band(49, 53, "8"), Band(55, 56, "9"), Band(58, 99, "10"),
)
NIC_THREE_BANDS = (Band(1, 3, "1"), Band(5, 43, "6"), Band(45, 99, "11"))
ATTENDANCE_BANDS = (
    Band(1, 5, "1"), Band(11, 15, "2"), Band(21, 24, "3"), Band(25, 25, "4"), Band(26, 26, "5"),
    Band(27, 27, "6"), Band(28, 31, "7"), Band(32, 32, "8"), Band(33, 43, "9"),
)
# Right-closed upper bounds; the last band is open.
SPENDING_UPPER_BOUNDS = (9999, 19999, 29999, 39999, 49999)

DURATION_BANDS = {
    "1": "Up to 6 months", "2": "Over 6 months to 1 year", "3": "Over 1 to 2 years",
    "4": "Over 2 to 3 years", "5": "Over 3 years",
}

LABELS = {
    "Social_group": {"1": "ST", "2": "SC", "3": "OBC", "9": "Others"},
    "Religion": {
        "1": "Hindu", "2": "Muslim", "3": "Christian", "4": "Sikh",
        "5": "Jain", "6": "Buddhist", "7": "Zoroastrian", "9": "Others",
    },
    "Broad_status": {
        "1": "Own-account worker or employer", "2": "Helper in household enterprise",
        "self": "All self-employed", "3": "Regular wage or salary", "4": "Casual labour",
    },
    "NIC_broad": {
        "1": "Agriculture", "2": "Mining and quarrying", "3": "Manufacturing",
        "4": "Electricity and water supply", "5": "Construction", "7": "Trade",
        "8": "Transport", "9": "Accommodation and food services", "10": "Other services",
    },
    "NIC_three": {"1": "Agriculture", "6": "Secondary", "11": "Tertiary"},
    "Training_code": {
        "1": "Formal", "2": "Hereditary", "3": "Self-learning",
        "4": "Learning on the job", "5": "Other non-formal", "6": "No vocational training",
    },
    "Training_duration": {
        "1": "Less than 3 months", "2": "3 to under 6 months", "3": "6 to under 12 months",
        "4": "12 to under 18 months", "5": "18 to under 24 months", "6": "24 months or more",
    },
    "Training_type": {
        "1": "On the job", "2": "Off the job, part-time", "3": "Off the job, full-time",
    },
    "Social_security": {
        "1": "PF/pension only", "2": "Gratuity only", "3": "Health/maternity only",
        "4": "PF/pension and gratuity", "5": "PF/pension and health/maternity",
        "6": "Gratuity and health/maternity", "7": "All three benefits",
        "8": "Not eligible for these benefits", "9": "Not known",
    },
    "Economic_months": DURATION_BANDS,
    "Unemployment_duration": DURATION_BANDS,
    "Efforts_to_find_work": {
        "1": "Employers, advertisements or work sites", "2": "Employment exchange",
        "3": "Private employment centre", "4": "Finance to start a business",
        "5": "Relatives or friends", "6": "Business permit or licence", "7": "Other efforts",
    },
    "Marital_status": {
        "1": "Never married", "2": "Currently married", "3": "Widowed",
        "4": "Divorced or separated",
    },
    "Attendance_group": {
        "1": "Never attended", "2": "Attended, not currently attending", "3": "Up to primary",
        "4": "Middle", "5": "Secondary", "6": "Higher secondary", "7": "Graduate",
        "8": "Postgraduate or above", "9": "Diploma or certificate",
    },
    "Household_spending_band": {
        "1": "Below Rs 10,000", "2": "Rs 10,000-19,999", "3": "Rs 20,000-29,999",
        "4": "Rs 30,000-39,999", "5": "Rs 40,000-49,999", "6": "Rs 50,000 or more",
    },
    "State_code": {
        "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh",
        "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan",
        "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh",
        "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya",
        "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha",
        "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat",
        "25": "Dadra and Nagar Haveli and Daman and Diu", "27": "Maharashtra",
        "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa", "31": "Lakshadweep",
        "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
        "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Ladakh",
    },
}
TOTAL_CODE = "total"
TOTAL_LABEL = "All reported categories"

# Layout of the published pages: six status columns, nine sector x gender columns.
STATUS_COLUMNS = ("1", "2", "self", "3", "4", "total")
PUBLISHED_GROUP_HEADINGS = {
    "scheduled tribe": "ST", "scheduled caste": "SC", "other backward classes": "OBC",
}

# Wage-model dummies: column -> General_education codes that set it to 1.
EDUCATION_DUMMIES = {
    "dummy_primary_below": (5,),
    "dummy_middle": (7,),
    "dummy_secondary": (8,),
    "dummy_higher_secondary": (10,),
    "dummy_graduate_diploma": (11, 12),
    "dummy_postgraduate": (13,),
}
# ---------------------------------------------------------------------------
