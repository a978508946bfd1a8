"""Workflows and state over streams."""
