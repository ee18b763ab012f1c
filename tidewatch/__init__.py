"""Event-abuse analytics as PySpark DataFrame jobs."""
