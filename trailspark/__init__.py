"""Trail-journal analytics on Spark DataFrames."""
