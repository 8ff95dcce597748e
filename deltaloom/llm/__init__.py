"""Operators of a training-data pipeline, each a function on DataFrames.

Nothing outside this folder imports it; ``queries`` registers one query for each operator.
"""
