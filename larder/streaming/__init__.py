"""Incremental ingestion of store snapshots."""
