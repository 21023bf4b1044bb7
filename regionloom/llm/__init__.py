"""Operators that a training-data pipeline needs, one module for each.

``queries.py`` registers them over the standard tables.  Nothing outside this
subpackage imports it.
"""
