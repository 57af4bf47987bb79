"""All queries with their DuckDB statements."""

from __future__ import annotations

from functools import lru_cache

from . import checking, core, modelling, profiling, reporting, scoring
from .base import Registry


@lru_cache(maxsize=1)
def registry() -> Registry:
    reg = Registry()
    for part in (core, profiling, reporting, scoring, modelling, checking):
        part.register(reg)
    return reg
