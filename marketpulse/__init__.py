"""Quarterly regulated-market analytics as Spark DataFrame jobs."""

from marketpulse.spec import MED, ODO, Account, Category, SegmentSpec

__all__ = ["MED", "ODO", "Account", "Category", "SegmentSpec"]
