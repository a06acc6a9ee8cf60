"""Relational operators on session-partitioned DataFrames."""
