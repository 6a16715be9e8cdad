"""Growing files and time buckets that close."""
