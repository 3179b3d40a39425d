"""Command-reference analytics on Spark: manuals and recorded terminal output as DataFrames."""
