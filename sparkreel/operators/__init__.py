"""Operators of the sample-stream engine."""
