"""Evidence recall and analytics over conversation and document history, on Spark DataFrames."""
