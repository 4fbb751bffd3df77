"""Curation of large collections of recordings, and training-data operators, on PySpark."""
