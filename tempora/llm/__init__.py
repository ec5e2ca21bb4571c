"""Operators of a large-scale text-corpus pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``registry`` holds the queries and SQL built on them.
"""
