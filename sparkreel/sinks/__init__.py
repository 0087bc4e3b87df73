"""Sinks of the sample-stream engine."""
