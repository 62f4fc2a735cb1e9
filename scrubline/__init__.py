"""Table cleaning and data quality on Spark."""
