"""Content-addressed, versioned and replicated data on Spark DataFrames."""
