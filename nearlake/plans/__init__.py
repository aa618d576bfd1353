"""Named queries: importing this package fills the registry."""

from nearlake.plans import mutation_queries, search_queries, structure_queries, tree_queries, vector_queries  # noqa: F401
from nearlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
