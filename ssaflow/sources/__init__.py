"""Files that workflows, manifests and contexts come from."""
