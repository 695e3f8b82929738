"""All registered queries (importing the query modules fills the registry)."""

from . import job_queries, source_queries, state_queries, styled_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
