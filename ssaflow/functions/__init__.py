"""The shipped tasks."""
