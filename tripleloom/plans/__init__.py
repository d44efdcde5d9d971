"""Bindings onto the benchmark tables and the query catalogue."""
