"""Readers: parquet tables, delimited feeds, documents and binary files."""
