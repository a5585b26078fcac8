"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

Each module holds one operator with a general interface (any id and text
column); ``queries`` binds them to the given tables.
"""
