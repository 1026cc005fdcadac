"""quarrymill: analytics over documentation corpora as Spark DataFrames."""
