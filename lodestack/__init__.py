"""lodestack: a content-addressed, deduplicating data engine expressed in PySpark."""

__version__ = "0.1.0"
