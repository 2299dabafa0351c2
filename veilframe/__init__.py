"""Privacy-preserving analytics on Spark."""
