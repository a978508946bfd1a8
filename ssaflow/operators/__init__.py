"""Tasks, and the control plane's queries."""
