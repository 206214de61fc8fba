"""Readers for files and table formats."""

from millrace.sources.access import AccessDenied, AccessPolicy, configure_store
from millrace.sources.files import read_blob, read_csv, read_json, read_parquet, read_text
from millrace.sources.tables import delta_scan, iceberg_metadata, iceberg_scan, iceberg_snapshots

__all__ = ["AccessDenied", "AccessPolicy", "configure_store", "delta_scan", "iceberg_metadata", "iceberg_scan", "iceberg_snapshots", "read_blob", "read_csv", "read_json", "read_parquet", "read_text"]
