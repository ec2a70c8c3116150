"""Document search and corpus preparation as PySpark jobs."""
