"""Operators for large training-data jobs. Nothing outside this folder imports it."""
