"""Record matching, data-quality and governance analytics as PySpark jobs."""
