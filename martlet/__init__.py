"""Product analytics expressed as Spark DataFrame jobs."""
