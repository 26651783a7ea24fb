"""Named queries over the given tables; importing this package fills ``QUERIES``."""

from devprism.registry import clustering, features, mining, sentiment, steps, text  # noqa: F401
from devprism.registry.core import QUERIES, Query

__all__ = ["QUERIES", "Query"]
