"""Incremental versions of the append-shaped feeds."""
