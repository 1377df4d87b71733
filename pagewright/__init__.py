"""Page-resource analytics on PySpark."""
