"""Plans of the sample-stream engine."""
