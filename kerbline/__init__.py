"""Camera-network sighting analytics on Spark DataFrames."""
