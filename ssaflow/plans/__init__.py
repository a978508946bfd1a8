"""Tracing, analysis, interpretation and lowering of workflows."""
