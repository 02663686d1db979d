"""Document-knowledge analytics as Spark DataFrame jobs."""
