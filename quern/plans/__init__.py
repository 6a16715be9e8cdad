"""Grammars, queries and their plans."""
