"""Scans and sinks: table access, CSV/JSON/Parquet readers and writers."""
