"""millrace: analytics and training-data operators written as Spark DataFrame jobs."""
