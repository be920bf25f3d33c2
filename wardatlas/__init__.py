"""District-plan analytics as PySpark DataFrame jobs."""
