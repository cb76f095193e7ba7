"""Point-sequence analytics on Spark."""
