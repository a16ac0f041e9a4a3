"""Operators on training-data text. Nothing outside this package imports it."""
