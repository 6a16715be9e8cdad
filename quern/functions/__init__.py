"""Spark columns for logfmt text, times and output rows."""
