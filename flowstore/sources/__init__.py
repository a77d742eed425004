"""Catalog, readers and writers."""
