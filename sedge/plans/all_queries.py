"""Every query of the reference's operators: importing this module fills the registry."""

from sedge.plans import ingest_queries, job_queries, search_queries, store_queries, text_queries  # noqa: F401
from sedge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
