"""All registered queries of the analytics engine."""

from . import composed, corpus, frames, funds, lookups, market, more, research, stored, vendor  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
