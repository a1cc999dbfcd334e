"""Frames and SQL fragments that several catalog modules use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import fields
from ...operators import features as ft
from ...session import stage
from ..bindings import prelude, wide

# The columns of the bound customer table, by role.
GAPS = ["revenue", "mou", "overage", "age2"]
NUMBERS = [c for c in fields.NUMERIC]
FLAGS = [
    "children", "credita", "creditaa", "creditcd", "prizmrur", "prizmub", "prizmtwn", "refurb", "truck", "rv",
    "occprof", "occcler", "occcrft", "occret", "occself", "ownrent", "marryyes", "travel", "pcown", "newcelly",
    "newcelln", "retcalls", "retaccpt", "retcall",
]
TEXTS = ["segment", "prizm_cluster"]
CATEGORIES = [*FLAGS, *TEXTS]

# Oracle text of the derived features.
FORMULA_SQL = {
    "engagement_index": "(outcalls + incalls) / (months + 1)",
    "model_change_rate": "models / (months + 1)",
    "overage_ratio": "overage / (revenue + 1)",
    "call_activity_score": "mou + mourec + 0.5e0 * (outcalls + incalls + peakvce + opeakvce)",
    "call_quality_issues": "dropvce + blckvce + unansvce + dropblk",
    "cust_engagement_score": "custcare + retcalls + 2 * retaccpt",
    "overuse_behavior": "overage + 0.5e0 * (directas + recchrge)",
    "device_tenure_index": "0.5e0 * models + eqpdays / 100e0 + refurb",
    "demographic_index": "(age1 + age2) / 2e0 + 2 * children + income / 10000e0",
    "socio_tier": "credita + 2 * creditaa + prizmub + 0.5e0 * prizmtwn",
    "occupation_class": "occprof + occcler + occcrft + occret + occself",
    "household_lifestyle_score": "ownrent + marryyes + pcown + creditcd + travel + truck + rv",
    "churn_change_score": "changem + changer + newcelly + newcelln - 0.5e0 * refer",
}

_MODE = (
    "(SELECT prizm_cluster FROM {0} WHERE prizm_cluster IS NOT NULL "
    "GROUP BY prizm_cluster ORDER BY count(*) DESC, prizm_cluster LIMIT 1)"
)


def landed(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The customer view written once, for operators that pass over it several times."""
    return stage(wide(spark, sf_dir, columns), "customers")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table imputed with its own medians and modes."""
    df = landed(spark, sf_dir)
    return ft.impute(df, ft.fit_median_mode(df, NUMBERS, CATEGORIES))


def training_part(df: DataFrame) -> DataFrame:
    """The population that fitted state comes from when it is applied to everybody."""
    return df.where(F.col("segment") != "BUILDING")


TRAINING_SQL = "train AS (SELECT * FROM w WHERE segment <> 'BUILDING')"


def filled_sql(source: str = "w", name: str = "wi", out_of: str = "w") -> str:
    """CTEs that fill ``out_of`` with the medians and the mode of ``source``."""
    medians = ", ".join(f"median({c}) AS {c}" for c in GAPS)
    fills = ", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in GAPS)
    return (
        f"{name}_m AS (SELECT {medians}, {_MODE.format(source)} AS prizm_cluster FROM {source}),\n"
        f"{name} AS (SELECT t.* REPLACE ({fills}, coalesce(t.prizm_cluster, m.prizm_cluster) AS prizm_cluster) "
        f"FROM {out_of} t CROSS JOIN {name}_m m)"
    )


def derived_sql(names: list[str]) -> str:
    return ", ".join(f"CAST({FORMULA_SQL[n]} AS DOUBLE) AS {n}" for n in names)


W_SQL = prelude("w")
FILLED_SQL = f"{W_SQL},\n{filled_sql()}"
