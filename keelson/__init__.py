"""Keyed and semi-structured data processing written for Spark DataFrames."""
