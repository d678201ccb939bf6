"""Spark-native versioned-table analytics: access paths, version logs, lot matching and workload queries."""
