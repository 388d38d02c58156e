"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from catalog import balancing, clusters, counting, evaluation, ingestion, taxonomy, textual  # noqa: F401
from catalog.registry import QUERIES, SQL  # noqa: F401
