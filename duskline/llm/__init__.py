"""Operators of a training-data pipeline: deduplication, scoring, tokens, search and mixing.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames and keeps its own general interface; `queries` holds the
thin registered queries and their SQL twins.
"""
