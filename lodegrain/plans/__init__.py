"""Operators put together: searching, pruning, and the query catalogue."""
