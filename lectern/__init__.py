"""Lectern: building and querying multilingual text corpora with PySpark."""
