"""A prose and operations analytics engine on PySpark."""
