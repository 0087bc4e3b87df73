"""Streaming of the sample-stream engine."""
