"""Names and values of the customer record."""

from __future__ import annotations

# Column groups of the raw customer table.
DISCARD = ["Unnamed: 0", "X", "customer", "traintest", "churndep"]

NUMERIC = [
    "revenue", "mou", "recchrge", "directas", "overage", "roam", "changem", "changer", "dropvce", "blckvce",
    "unansvce", "custcare", "threeway", "mourec", "outcalls", "incalls", "peakvce", "opeakvce", "dropblk",
    "callfwdv", "callwait", "months", "uniqsubs", "actvsubs", "phones", "models", "eqpdays", "age1", "age2",
    "refer", "income", "setprc",
]

CATEGORICAL = [
    "children", "credita", "creditaa", "prizmrur", "prizmub", "prizmtwn", "refurb", "webcap", "truck", "rv",
    "occprof", "occcler", "occcrft", "occstud", "occhmkr", "occret", "occself", "ownrent", "marryun",
    "marryyes", "mailord", "mailres", "mailflag", "travel", "pcown", "creditcd", "newcelly", "newcelln",
    "incmiss", "mcycle", "setprcm", "retcall", "retcalls", "retaccpt",
]

DERIVED = [
    "engagement_index", "model_change_rate", "overage_ratio", "call_activity_score", "call_quality_issues",
    "cust_engagement_score", "overuse_behavior", "device_tenure_index", "demographic_index", "socio_tier",
    "occupation_class", "household_lifestyle_score", "churn_change_score",
]

TARGET = "churn"

# Columns never stored after ingest.
INGEST_DROP = ["unnamed:_0", "x", "customer", "traintest", "row_id", "index", "unnamed"]

# Accepted aliases, grouped by the canonical column they stand for.
ALIASES = {
    "customer_id": ["customerid", "cust_id", "id"],
    "months": ["tenure", "month"],
    "phones": ["phone"],
    "mou": ["minutes_of_use"],
    "outcalls": ["out_calls"],
    "incalls": ["in_calls"],
    "peakvce": ["peak_vce"],
    "opeakvce": ["off_peak_vce"],
    "dropvce": ["drop_vce"],
    "blckvce": ["blck_vce"],
    "unansvce": ["unans_vce"],
    "threeway": ["three_way"],
    "callwait": ["call_wait"],
    "callfwdv": ["call_fwd"],
    "dropblk": ["drop_blk"],
    "custcare": ["cust_care"],
    "mourec": ["mou_rec"],
    "recchrge": ["recurring_charge"],
    "directas": ["direct_as"],
    "changem": ["change_mou"],
    "changer": ["change_revenue"],
    "revenue": ["total_revenue"],
    "eqpdays": ["eqp_days", "equipment_days"],
    "actvsubs": ["actv_subs"],
    "uniqsubs": ["uniq_subs"],
    "webcap": ["web_cap"],
    "age1": ["age_1"],
    "age2": ["age_2"],
    "credita": ["credit_a"],
    "creditaa": ["credit_aa"],
    "creditcd": ["credit_cd"],
    "retcalls": ["ret_calls"],
    "retaccpt": ["ret_accpt"],
    "mailord": ["mail_ord"],
    "mailres": ["mail_res"],
    "pcown": ["pc_own"],
    "prizm_cluster": ["prizm"],
    "marital_status": ["marital"],
    "ownrent": ["own_rent"],
    "newcelly": ["new_cell_y"],
    "newcelln": ["new_cell_n"],
    "setprcm": ["set_prcm"],
    "setprc": ["set_prc"],
    "retcall": ["ret_call"],
    "churn": ["churndep"],
}

# Text forms of a flag, and the columns that carry flags (``refer`` is a count).
FLAG_ONE = ["Yes", "yes", "YES", "Y", "y", "1"]
FLAG_ZERO = ["No", "no", "NO", "N", "n", "0"]
FLAG_COLUMNS = [
    "refurb", "webcap", "children", "truck", "rv", "mcycle", "credita", "creditaa", "creditcd", "mailord",
    "mailres", "travel", "pcown", "ownrent", "newcelly", "newcelln", "setprcm", "retcall", "churn",
]

# Columns parsed as numbers on ingest, as fractions and as whole numbers.
FRACTION_COLUMNS = [
    "mou", "outcalls", "incalls", "peakvce", "opeakvce", "dropvce", "blckvce", "unansvce", "threeway",
    "callwait", "callfwdv", "dropblk", "custcare", "mourec", "recchrge", "directas", "overage", "roam",
    "changem", "changer", "revenue", "setprc",
]
WHOLE_COLUMNS = [
    "months", "phones", "eqpdays", "models", "actvsubs", "uniqsubs", "age1", "age2", "income", "retcalls",
    "retaccpt",
]
TEXT_CATEGORIES = ["prizm_cluster", "occupation", "marital_status"]

# Text forms of the target.
TARGET_ONE = ["True", "Yes", "true", "yes", "1"]
TARGET_ZERO = ["False", "No", "false", "no", "0"]

# Form choices and the flag each one sets.
DROPDOWNS = {
    "prizm_cluster": {"rural": "prizmrur", "urban": "prizmub", "town": "prizmtwn"},
    "occupation": {
        "professional": "occprof", "clerical": "occcler", "craft": "occcrft", "student": "occstud",
        "homemaker": "occhmkr", "retired": "occret", "self-employed": "occself",
    },
    "marital_status": {"married": "marryyes", "unmarried": "marryun"},
}

# Fields with a row rule of their own family.
NON_NEGATIVE = [
    "revenue", "mou", "recchrge", "directas", "overage", "roam", "dropvce", "blckvce", "unansvce", "custcare",
    "threeway", "mourec", "outcalls", "incalls", "peakvce", "opeakvce", "dropblk", "callfwdv", "callwait",
    "months", "uniqsubs", "actvsubs", "phones", "models", "eqpdays", "refer", "setprc",
]
BINARY = [c for c in CATEGORICAL if c != "retcalls"]


# The declared column contract.  Floats without nulls, floats, integer flags.
CONTRACT_REQUIRED = [
    "revenue", "mou", "recchrge", "months", "uniqsubs", "actvsubs", "phones",
]
CONTRACT_FLOATS = [
    "directas", "roam", "changem", "changer", "dropvce", "blckvce", "unansvce", "custcare", "threeway", "mourec",
    "peakvce", "opeakvce", "dropblk", "callfwdv", "callwait", "models", "eqpdays", "age1", "age2", "refer",
    "income", "setprc", "engagement_index", "model_change_rate", "overage_ratio", "call_activity_score",
    "call_quality_issues", "cust_engagement_score", "overuse_behavior", "device_tenure_index", "demographic_index",
    "socio_tier", "occupation_class", "household_lifestyle_score", "churn_change_score",
]
CONTRACT_FLAGS = [
    "children", "credita", "creditaa", "prizmrur", "prizmub", "prizmtwn", "refurb", "webcap", "truck", "rv",
    "occprof", "occcler", "occcrft", "occstud", "occhmkr", "occret", "occself", "ownrent", "marryun", "marryyes",
    "mailord", "mailres", "mailflag", "travel", "pcown", "creditcd", "newcelly", "newcelln", "incmiss", "mcycle",
    "setprcm", "retcall", "retcalls", "retaccpt",
]


def column_contract() -> dict[str, dict]:
    """The declared column contract: type, null policy and allowed values per column."""
    kinds = {c: {"dtype": "float", "allow_null": False} for c in CONTRACT_REQUIRED}
    kinds |= {c: {"dtype": "float", "allow_null": True} for c in CONTRACT_FLOATS}
    contract = {c: kinds[c] for c in [*NUMERIC, *DERIVED] if c in kinds}  # in the order of the columns
    contract.update({c: {"dtype": "int", "allow_null": True} for c in CONTRACT_FLAGS})
    contract[TARGET] = {"dtype": "int", "allow_null": False, "allowed_values": [0, 1]}
    return contract


# SQL type names and the engine type each one is checked as.
TYPE_NAMES = {
    "integer": "bigint", "int": "bigint", "bigint": "bigint", "smallint": "bigint", "int64": "bigint",
    "numeric": "double", "real": "double", "double precision": "double", "double": "double", "float": "double",
    "float64": "double", "text": "string", "varchar": "string", "char": "string", "date": "string",
    "object": "string", "string": "string", "boolean": "boolean", "bool": "boolean", "timestamp": "timestamp",
    "timestamptz": "timestamp", "timestamp_ntz": "timestamp", "datetime64[ns]": "timestamp",
}
