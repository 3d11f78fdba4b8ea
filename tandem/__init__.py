"""Paired, clustered evaluation analytics expressed as Spark DataFrame jobs."""
