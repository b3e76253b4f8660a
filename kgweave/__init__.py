"""Knowledge-graph reasoning analytics on Spark."""
