"""Financial-statement analytics over any number of documents, as Spark DataFrames."""
