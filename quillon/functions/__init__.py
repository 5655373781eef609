"""Column functions shared by the operators."""

from quillon.functions import metrics

__all__ = ["metrics"]
