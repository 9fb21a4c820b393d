"""Page analytics as Spark DataFrame jobs."""
