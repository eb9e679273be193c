"""Data-pipeline observability on Spark: metric events in, lazy DataFrame answers out."""

__version__ = "0.1.0"
