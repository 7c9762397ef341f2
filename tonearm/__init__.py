"""Release-metadata quality and catalogue analytics on Spark DataFrames."""
