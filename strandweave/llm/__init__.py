"""Operators for large training-data pipelines, one module per operator.

Nothing outside this subpackage imports it.
"""
