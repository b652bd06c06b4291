"""millrace: review and news analytics as Spark DataFrame plans."""
