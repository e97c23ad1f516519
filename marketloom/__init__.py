"""Market-research analytics as PySpark DataFrame and Structured Streaming operators."""
