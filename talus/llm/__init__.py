"""Operators for training-data pipelines.

One module per operator; `queries` holds the thin digests that the driver
compares. Nothing outside this subpackage imports it.
"""
