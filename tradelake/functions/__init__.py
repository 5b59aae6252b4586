"""Column-level helpers (built-in Spark expressions only)."""

from .columns import *  # noqa: F401,F403
