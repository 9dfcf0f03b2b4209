"""Spark-first analytics over bitemporal evidence data."""
