"""Balanced spatial partitioning of large tables on Spark."""
