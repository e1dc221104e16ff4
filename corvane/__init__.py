"""Code-context retrieval and evaluation analytics on Spark."""
