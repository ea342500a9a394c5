"""Registered queries; importing the package registers all of them."""

from millrace.plans import datasets, ledger, lineage, relational, runlog, storage, streams  # noqa: F401
from millrace.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
