"""Column functions. All of them are built from Spark's own expressions."""
