"""Sample-stream and corpus processing on Spark DataFrames."""
