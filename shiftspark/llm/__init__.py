"""Operators for preparing training text, on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
