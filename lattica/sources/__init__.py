"""Spark-first sources of the graph analytics engine."""
