"""Point-cloud and mesh analytics as Spark DataFrames."""
