"""Registry of derived features: name → source columns and formula.

A formula takes a lookup ``name → Column`` so the same text serves raw, imputed and stored data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Lookup = Callable[[str], Column]


@dataclass(frozen=True)
class Formula:
    name: str
    sources: tuple[str, ...]
    build: Callable[[Lookup], Column]


REGISTRY: dict[str, Formula] = {}


def weighted(name: str, per: Mapping[str, float] | None = None, **weights: float) -> Formula:
    """Register a feature that is a weighted sum of its sources; those in ``per`` are divided by a number first."""
    per = per or {}

    def term(c: Lookup, source: str, weight: float) -> Column:
        value = c(source) / F.lit(float(per[source])) if source in per else c(source)
        return value if weight == 1 else value * F.lit(float(weight))


    def build(c: Lookup) -> Column:
        terms = [term(c, s, w) for s, w in weights.items()]
        total = terms[0]
        for more in terms[1:]:
            total = total + more
        return total.cast("double")

    return register(Formula(name, tuple(weights), build))


def rate(name: str, parts: tuple[str, ...], per: str) -> Formula:
    """Register a feature that is the sum of its parts per unit of ``per + 1`` (null at zero)."""

    def build(c: Lookup) -> Column:
        top = c(parts[0])
        for p in parts[1:]:
            top = top + c(p)
        return F.try_divide(top, c(per) + F.lit(1.0)).cast("double")

    return register(Formula(name, (*parts, per), build))


def register(formula: Formula) -> Formula:
    REGISTRY[formula.name] = formula
    return formula


# The thirteen derived features.
rate("engagement_index", ("outcalls", "incalls"), per="months")
rate("model_change_rate", ("models",), per="months")
rate("overage_ratio", ("overage",), per="revenue")
weighted("call_activity_score", mou=1, mourec=1, outcalls=0.5, incalls=0.5, peakvce=0.5, opeakvce=0.5)
weighted("call_quality_issues", dropvce=1, blckvce=1, unansvce=1, dropblk=1)
weighted("cust_engagement_score", custcare=1, retcalls=1, retaccpt=2)
weighted("overuse_behavior", overage=1, directas=0.5, recchrge=0.5)
weighted("device_tenure_index", per={"eqpdays": 100}, models=0.5, eqpdays=1, refurb=1)
weighted("demographic_index", per={"income": 10000}, age1=0.5, age2=0.5, children=2, income=1)
weighted("socio_tier", credita=1, creditaa=2, prizmub=1, prizmtwn=0.5)
weighted("occupation_class", occprof=1, occcler=1, occcrft=1, occret=1, occself=1)
weighted("household_lifestyle_score", ownrent=1, marryyes=1, pcown=1, creditcd=1, travel=1, truck=1, rv=1)
weighted("churn_change_score", changem=1, changer=1, newcelly=1, newcelln=1, refer=-0.5)

# Feature groups that can be computed on their own.
GROUPS = {
    "usage": ["engagement_index", "model_change_rate", "overage_ratio", "overuse_behavior"],
    "calls": ["call_activity_score", "call_quality_issues", "cust_engagement_score"],
    "profile": ["device_tenure_index", "demographic_index", "socio_tier", "occupation_class"],
    "household": ["household_lifestyle_score", "churn_change_score"],
}
