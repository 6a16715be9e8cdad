"""Slicing, filtering and aggregation of logs, and corpus operators, on Spark."""
