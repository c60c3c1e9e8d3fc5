"""Spark-native analytics over document collections, page plans and ordered records."""

from sheaf.session import get_session

__all__ = ["get_session"]
