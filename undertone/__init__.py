"""undertone: audience-feedback analytics as Spark DataFrame jobs."""
