"""Spark-first operators of the graph analytics engine."""
