"""Measurement-text analytics on plain PySpark."""
