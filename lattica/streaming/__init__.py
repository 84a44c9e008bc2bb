"""Spark-first streaming of the graph analytics engine."""
