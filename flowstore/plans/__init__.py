"""Pipeline compilation and physical-plan helpers (lineage cuts)."""
