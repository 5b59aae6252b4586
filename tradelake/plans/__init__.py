"""Warehouse state, registered queries and their oracle SQL."""

from . import q_analyst, q_core, q_sources, q_state  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES  # noqa: F401
