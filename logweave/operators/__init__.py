"""Relational operators of the engine: matching, grouping, splitting, extraction, merging, scoring."""
