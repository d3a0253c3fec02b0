"""All queries of the library and their SQL."""

from __future__ import annotations

from . import basic, clustering  # noqa: F401  they register themselves
from .fixtures import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
