"""Readers and writers: Parquet tables, tab-separated seed files, change logs, snapshots, counters and scratch tables."""

from tidemark.sources.tables import append_log, claim, complete, read_flat, read_log, table, write_counters, write_snapshot

__all__ = ["append_log", "claim", "complete", "read_flat", "read_log", "table", "write_counters", "write_snapshot"]
