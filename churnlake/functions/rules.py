"""Registry of row rules: name → predicate that is true when the row breaks the rule.

Predicates never return null, so a rule either fires or does not.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields


@dataclass(frozen=True)
class RowRule:
    name: str
    sources: tuple[str, ...]
    broken: Column


def _sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def non_negative(name: str) -> RowRule:
    return RowRule(f"{name}_non_negative", (name,), _sure(F.col(name) < 0))


def between(name: str, lo: float, hi: float) -> RowRule:
    c = F.col(name)
    return RowRule(f"{name}_range", (name,), _sure((c < lo) | (c > hi)))


def binary(name: str) -> RowRule:
    return RowRule(f"{name}_binary", (name,), _sure(~F.col(name).cast("double").isin(0.0, 1.0)))


def customer_rules() -> list[RowRule]:
    """Every rule of the customer record, in reporting order."""
    c = F.col
    cross = [
        RowRule("age_order", ("age1", "age2"), _sure(c("age1") < c("age2"))),
        RowRule("newcell_exclusive", ("newcelly", "newcelln"), _sure((c("newcelly") == 1) & (c("newcelln") == 1))),
        RowRule("newcell_present", ("newcelly", "newcelln"), c("newcelly").isNull() & c("newcelln").isNull()),
        RowRule("actvsubs_within_uniqsubs", ("actvsubs", "uniqsubs"), _sure(c("actvsubs") > c("uniqsubs"))),
        RowRule(
            "actvsubs_at_least_one",
            ("actvsubs", "uniqsubs"),
            _sure(c("uniqsubs").isNotNull() & (c("actvsubs") < 1)),
        ),
        RowRule(
            "retcall_has_calls",
            ("retcall", "retcalls"),
            _sure((c("retcall") == 1) & (F.coalesce(c("retcalls"), F.lit(0)) < 1)),
        ),
    ]
    return [
        *[non_negative(n) for n in fields.NON_NEGATIVE],
        between("age1", 0, 120),
        between("age2", 0, 120),
        between("income", 0, 9),
        *[binary(n) for n in fields.BINARY],
        *cross,
        binary(fields.TARGET),
    ]


def applicable(rules: Iterable[RowRule], columns: Iterable[str]) -> list[RowRule]:
    """The rules whose source columns are all present."""
    present = set(columns)
    return [r for r in rules if present.issuperset(r.sources)]


def errors(rules: Iterable[RowRule]) -> Column:
    """``array<string>`` of the rules a row breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
