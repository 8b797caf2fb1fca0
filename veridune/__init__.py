"""Integrity analytics as Spark plans: calibrated ranks, multiple testing, drift, duplicates, censuses, chains and monitors."""

__version__ = "0.1.0"
