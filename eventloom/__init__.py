"""Eventloom: evidence-first event analytics on PySpark DataFrames."""

__version__ = "0.1.0"
