"""Keyed stream jobs on Spark: a declarative DAG compiled to DataFrames."""
