"""Spark-first alignment and coupling of two-clock biosignal recordings."""
