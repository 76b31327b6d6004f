"""Named queries over the tables, each with the SQL that equals it where SQL can express it."""

from sedge.plans import graph_queries, index_queries, memory_queries, text_queries  # noqa: F401
from sedge.plans.registry import ORACLES, QUERIES  # noqa: F401
