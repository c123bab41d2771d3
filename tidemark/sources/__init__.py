"""Readers, the versioned Parquet store, and window landing."""
