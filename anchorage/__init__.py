"""Anchorage: evidence-grounded document analytics on PySpark."""
