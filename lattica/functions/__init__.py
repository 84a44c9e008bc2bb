"""Spark-first functions of the graph analytics engine."""
