"""engram: retrieval, association-graph and corpus analytics on Spark DataFrames."""
