"""Sources of the sample-stream engine: containers read through Spark's binaryFile, so any store that Spark reads will do."""
