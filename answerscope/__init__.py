"""AI-search visibility analytics as plain PySpark DataFrame jobs."""

from .session import get_spark

__all__ = ["get_spark"]
