"""Workflows of plain Python tasks, run as Spark DataFrames."""

__version__ = "0.1.0"
