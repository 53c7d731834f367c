"""Fixed values that must equal the reference's for identical results.

FIXED VALUES - kept verbatim, in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES ---------------------------------------------------------

# Chronic-condition flag columns of the beneficiary table (1 = yes, 2 = no).
CHRONIC_CONDITIONS = [
    "ChronicCond_Alzheimer",
    "ChronicCond_Heartfailure",
    "ChronicCond_KidneyDisease",
    "ChronicCond_Cancer",
    "ChronicCond_ObstrPulmonary",
    "ChronicCond_Depression",
    "ChronicCond_Diabetes",
    "ChronicCond_IschemicHeart",
    "ChronicCond_Osteoporasis",
    "ChronicCond_rheumatoidarthritis",
    "ChronicCond_stroke",
]

# Race code -> label (unmapped codes become null).
RACE_NAMES = {1: "White", 2: "Black", 3: "Other", 5: "Hispanic", 0: "Unknown"}

# State FIPS code -> state name (unmapped codes become null).
STATE_NAMES = {
    1: "Alabama", 2: "Alaska", 4: "Arizona", 5: "Arkansas", 6: "California",
    8: "Colorado", 9: "Connecticut", 10: "Delaware", 11: "DC", 12: "Florida",
    13: "Georgia", 15: "Hawaii", 16: "Idaho", 17: "Illinois", 18: "Indiana",
    19: "Iowa", 20: "Kansas", 21: "Kentucky", 22: "Louisiana", 23: "Maine",
    24: "Maryland", 25: "Massachusetts", 26: "Michigan", 27: "Minnesota",
    28: "Mississippi", 29: "Missouri", 30: "Montana", 31: "Nebraska",
    32: "Nevada", 33: "New Hampshire", 34: "New Jersey", 35: "New Mexico",
    36: "New York", 37: "North Carolina", 38: "North Dakota", 39: "Ohio",
    40: "Oklahoma", 41: "Oregon", 42: "Pennsylvania", 44: "Rhode Island",
    45: "South Carolina", 46: "South Dakota", 47: "Tennessee", 48: "Texas",
    49: "Utah", 50: "Vermont", 51: "Virginia", 53: "Washington", 54: "West Virginia",
    55: "Wisconsin", 56: "Wyoming",
}

# Age bins: left-closed edges and their labels (the labels use an en dash).
AGE_EDGES = [0, 20, 30, 40, 50, 60, 70, 80, 100]
AGE_LABELS = ["0–20", "21–30", "31–40", "41–50", "51–60", "61–70", "71–80", "81+"]

# Age group label -> midpoint, and -> ordinal.
AGE_MIDPOINTS = {
    "0–20": 10, "21–30": 25, "31–40": 35, "41–50": 45,
    "51–60": 55, "61–70": 65, "71–80": 75, "81+": 85,
}
AGE_ORDINALS = {
    "0–20": 0, "21–30": 1, "31–40": 2, "41–50": 3,
    "51–60": 4, "61–70": 5, "71–80": 6, "81+": 7,
}

# Reference year / date for the two age definitions.
AGE_REFERENCE_YEAR = 2009
AGE_REFERENCE_DATE = "2009-12-31"

# Fraud label values and their 0/1 encoding.
LABEL_YES = "Yes"
LABEL_NO = "No"
LABEL_CODES = {"Yes": 1, "No": 0}

# Claim source tags and their feature encoding.
SOURCE_INPATIENT = "Inpatient"
SOURCE_OUTPATIENT = "Outpatient"
SOURCE_CODES = {"Inpatient": 1, "Outpatient": 2}

# Physician columns, diagnosis / procedure column prefixes.
PHYSICIAN_COLS = ["AttendingPhysician", "OperatingPhysician", "OtherPhysician"]
DIAGNOSIS_PREFIX = "ClmDiagnosisCode"
PROCEDURE_PREFIX = "ClmProcedureCode"
N_DIAGNOSIS = 10
N_PROCEDURE = 6

# Duplicate-claim key sets.
DUP_KEYS_CLAIM = ["ClaimID"]
DUP_KEYS_FIVE = ["BeneID", "Provider", "ClaimStartDt", "ClaimEndDt", "InscClaimAmtReimbursed"]
DUP_KEYS_DIAG_PROC = ["Provider", "ClmDiagnosisCode_1", "ClmProcedureCode_1"]

# Graph: vertex types, edge relationship names, node drawing attributes.
VERTEX_PATIENT = "patient"
VERTEX_PROVIDER = "provider"
VERTEX_DOCTOR = "doctor"
REL_VISITED = "visited"
REL_AFFILIATED = "affiliated_with"
REL_USED_PROVIDER = "used_provider"
REL_TREATS = "treats_patient"
REL_ATTENDED = "attended_by"
REL_OPERATED = "operated_by"
NODE_COLOR_FRAUD = "red"
NODE_COLOR_OTHER = "skyblue"
NODE_SIZE_FRAUD = 800
NODE_SIZE_OTHER = 300

# Modelling column sets.
NON_PREDICTIVE_A = [
    "BeneID", "ClaimID", "Provider", "AttendingPhysician",
    "OperatingPhysician", "OtherPhysician", "AdmissionDt", "DischargeDt",
    "ClaimStartDt", "ClaimEndDt", "DOB", "DOD", "PotentialFraud",
]
DROP_B = [
    "BeneID", "ClaimID", "AttendingPhysician", "OperatingPhysician", "OtherPhysician",
    "AdmissionDt", "ClaimStartDt", "ClaimEndDt",
]
DROP_B_LATER = ["Provider", "DischargeDt"]
DROP_C = [
    "BeneID", "ClaimID", "DOB", "DOD", "County",
    "AttendingPhysician", "OperatingPhysician", "OtherPhysician", "Provider",
    "AdmissionDt", "DischargeDt", "ClaimStartDt", "ClaimEndDt",
    "ClmAdmitDiagnosisCode",
]
FEATURES_D = [
    "InscClaimAmtReimbursed", "DeductibleAmtPaid", "DiagnosisGroupCode",
    "LengthOfStay", "Age",
    "ChronicCond_Alzheimer", "ChronicCond_Heartfailure", "ChronicCond_KidneyDisease",
    "ChronicCond_Cancer", "ChronicCond_ObstrPulmonary", "ChronicCond_Depression",
    "ChronicCond_Diabetes", "ChronicCond_IschemicHeart", "ChronicCond_Osteoporasis",
    "ChronicCond_rheumatoidarthritis", "ChronicCond_stroke",
    "IPAnnualReimbursementAmt", "IPAnnualDeductibleAmt",
    "OPAnnualReimbursementAmt", "OPAnnualDeductibleAmt",
    "State", "County",
]

# Explanation text (opening / closing lines by label, one line per contribution).
EXPLAIN_ROLE = "You are a healthcare fraud detection analyst."
EXPLAIN_OPEN_FRAUD = (
    "A model has flagged this claim as *Potentially Fraudulent*. Below are the SHAP contributions "
    "showing what features influenced the prediction:"
)
EXPLAIN_OPEN_OK = (
    "A model has *not* flagged this claim as fraudulent. Below are the SHAP contributions "
    "that influenced the model's decision:"
)
EXPLAIN_HEADER = "Top Feature Contributions:"
EXPLAIN_CLOSE_FRAUD = "Please explain why this claim might be fraudulent, based on these features."
EXPLAIN_CLOSE_OK = "Explain why this claim is likely legitimate or not flagged as fraudulent."
EXPLAIN_LINE_FORMAT = "- %s: %.4f"
EXPLAIN_TOP_K = 10

# Workload settings.
PAGERANK_RESET = 0.15
PAGERANK_ITERS = 10
LPA_ITERS = 5
SUBGRAPH_EDGES = 100
SUBGRAPH_COUNT = 2
SPLIT_TEST_FRACTION = 0.2
SEED = 42
CV_FOLDS = 5
HIGH_MISSING_THRESHOLD = 0.9

# --- end of FIXED VALUES --------------------------------------------------
