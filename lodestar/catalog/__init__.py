"""The registered queries and their SQL."""

from lodestar.catalog import evaluation, extensions, grouped, models  # noqa: F401
from lodestar.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
