"""Spark operators for table flows: sources, named datasets, sinks, lineage, ledgers and run logs."""

from millrace.operators.datasets import Datasets
from millrace.session import build_session, scratch_dir

__all__ = ["Datasets", "build_session", "scratch_dir"]
