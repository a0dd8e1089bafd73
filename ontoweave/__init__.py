"""Entity and taxonomy matching on Spark DataFrames."""
