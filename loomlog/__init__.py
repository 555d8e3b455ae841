"""Change-log analytics on Spark: versioned keyed logs, state, layout, replication."""
