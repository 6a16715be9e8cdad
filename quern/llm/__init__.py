"""Operators for large training corpora.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
when it is there. ``queries.py`` holds the registered queries, ``sql.py`` their SQL.
"""
