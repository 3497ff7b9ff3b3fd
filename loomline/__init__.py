"""Session-log analytics as Spark DataFrame jobs."""
