"""Queries over the given tables, one for each operator, with the same in SQL."""

from docloom.plans import evaluation_queries, graph_queries, more_queries, piece_queries, retrieval_queries, source_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from docloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
