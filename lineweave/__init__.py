"""Set-oriented analytics over recognised document lines, on Spark DataFrames."""
