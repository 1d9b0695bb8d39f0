"""redline: document-change and retrieval-evaluation analytics on Spark DataFrames."""
