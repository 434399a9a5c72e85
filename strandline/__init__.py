"""Spark-first cohort, property-graph and corpus analytics: pure functions from DataFrames to DataFrames."""
