"""Spark-first plans of the graph analytics engine."""
