"""Spark-first threat-intelligence document analytics."""

__version__ = "0.1.0"
