"""Spark-first analytics for document and knowledge collections."""
