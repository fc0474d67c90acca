"""Spark-first jobs over web-archive data: catalog, extraction, rewriting, text, safety, logs, streams."""
