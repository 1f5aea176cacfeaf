"""Code-graph analytics and data preparation as Spark DataFrame jobs."""
