"""Incremental jobs over arriving files."""
