"""Gene-graph association analytics on Spark."""
