"""Text-overlap analytics on PySpark."""
