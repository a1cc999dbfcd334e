"""The wide customer record from its satellite tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Satellite tables and their columns.
SATELLITES = {
    "usage_metrics": ["revenue", "mou", "recchrge", "directas", "overage", "roam"],
    "call_metrics": [
        "changem", "changer", "dropvce", "blckvce", "unansvce", "custcare", "threeway", "mourec", "outcalls",
        "incalls", "peakvce", "opeakvce", "dropblk", "callfwdv", "callwait",
    ],
    "tenure_info": ["months", "uniqsubs", "actvsubs"],
    "equipment_info": ["refurb", "phones", "models", "eqpdays"],
    "demographics": ["age1", "age2", "children", "income", "ownrent", "marryun", "marryyes"],
    "credit_profile": ["credita", "creditaa", "creditcd", "incmiss"],
    "prizm_segment": ["prizmrur", "prizmub", "prizmtwn"],
    "occupation_profile": ["occprof", "occcler", "occcrft", "occstud", "occhmkr", "ocret", "occself"],
    "household": ["truck", "rv", "mcycle"],
    "vehicles": ["truck", "rv", "mcycle"],
    "services_features": ["mailord", "mailres", "mailflag", "travel", "pcown", "webcap"],
    "retention_info": ["refer", "retcall", "retcalls", "retaccpt"],
    "financials": ["setprc", "setprcm"],
    "churn_label": ["churn"],
}

# Columns stored under a misspelt name.
RESPELT = {"ocret": "occret"}


def newest_row(satellite: DataFrame, key: str = "customer_id", order: str = "id") -> DataFrame:
    """The newest row per customer, found by an aggregate that shrinks repeats before the shuffle.

    Of rows with one ``order`` the greatest, column by column, counts, so that no two rows are ever mixed.
    """
    rest = [c for c in satellite.columns if c not in (key, order)]
    newest = F.max(F.struct(order, *rest)).alias("_newest")
    return satellite.groupBy(key).agg(newest).select(key, *[F.col(f"_newest.{c}").alias(c) for c in rest])


def customer_360(master: DataFrame, satellites: Mapping[str, DataFrame], key: str = "customer_id") -> DataFrame:
    """Master left-joined to every satellite.

    Each satellite is already partitioned on the key by its own aggregate, so the joins add no
    further shuffle of it.  Columns several satellites share are taken from the first that has one.
    """
    joined = master
    holders: dict[str, list[str]] = {}
    for name, satellite in satellites.items():
        newest = newest_row(satellite, key)
        columns = [c for c in newest.columns if c != key]
        newest = newest.withColumnsRenamed({c: f"{name}__{c}" for c in columns})
        joined = joined.join(newest, key, "left")
        for c in columns:
            holders.setdefault(RESPELT.get(c, c), []).append(f"{name}__{c}")
    merged = [F.coalesce(*many).alias(c) if len(many) > 1 else F.col(many[0]).alias(c) for c, many in holders.items()]
    return joined.select(*master.columns, *merged)


def split_satellites(columns: Iterable[str], layout: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """The satellite columns that a wide table with these columns can supply."""
    layout = SATELLITES if layout is None else layout
    present = set(columns)
    out = {name: [c for c in many if RESPELT.get(c, c) in present] for name, many in layout.items()}
    return {name: many for name, many in out.items() if many}
