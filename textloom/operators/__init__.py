"""Chunking as column functions, a table function and DataFrame helpers."""
