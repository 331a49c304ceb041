"""Murmur: feedback analytics as composable PySpark DataFrame operators."""

from murmur.schema import FeedbackError, FilterSpec, ValidationError

__all__ = ["FeedbackError", "FilterSpec", "ValidationError"]
