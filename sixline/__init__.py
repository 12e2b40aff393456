"""Symbolic-state analytics and data preparation as native Spark plans."""

__version__ = "0.1.0"
