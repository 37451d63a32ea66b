"""Query catalog.  Importing this package registers every query."""

from . import q_answers, q_generate, q_ledger, q_reports, q_sources, q_streams, q_stored, q_tenant  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
