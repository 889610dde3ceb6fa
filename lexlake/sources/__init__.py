"""Readers and writers: marks, append tables, keyed tables and published sheets."""
