"""Registered queries, one module per family; importing a module registers its queries."""

from . import (  # noqa: F401
    evaluation,
    ingest,
    modelling,
    monitoring,
    preparation,
    profiling,
    quality,
    sampling,
    streams,
    tables,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
