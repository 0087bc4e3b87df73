"""Functions of the sample-stream engine."""
