"""livedex: live text search and corpus preparation on PySpark."""
