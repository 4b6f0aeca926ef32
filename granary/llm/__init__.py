"""Operators of a training-data pipeline.

Each module holds one operator with its own interface. ``queries`` applies them to the test tables.
Nothing outside this subpackage imports it.
"""
