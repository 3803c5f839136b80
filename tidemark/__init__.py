"""Point-in-time event-study analytics as Spark DataFrame jobs."""
