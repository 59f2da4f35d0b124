"""docspark: analytics over document collections with PySpark."""
