"""Causal key-value analytics on Spark: versioned writes, replicas, conflict-free types, sorted runs, membership."""
