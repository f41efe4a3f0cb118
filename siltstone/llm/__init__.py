"""Operators of a training-data pipeline. Nothing outside this package imports it."""
