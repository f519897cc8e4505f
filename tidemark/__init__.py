"""tidemark: point-in-time prediction data as Spark DataFrame jobs."""
