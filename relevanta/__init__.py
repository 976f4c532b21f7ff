"""Search-relevance experiments on Spark."""
