"""Temporal fact analytics on PySpark."""
