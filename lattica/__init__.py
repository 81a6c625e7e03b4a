"""Graph and network analysis on Spark DataFrames."""
