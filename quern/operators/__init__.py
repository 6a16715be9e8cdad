"""Operators on parsed log lines."""
