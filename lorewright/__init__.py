"""lorewright: document-to-knowledge-graph analytics on Spark DataFrames."""
