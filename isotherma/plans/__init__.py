"""Registered queries. Importing the modules fills the catalog."""

from . import join_queries, metric_queries, model_queries, profile_queries, scalar_queries, source_queries  # noqa: F401
from .registry import CATALOG  # noqa: F401
