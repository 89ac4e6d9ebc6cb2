"""Monthly purchase features and signal positioning as Spark DataFrame jobs."""
