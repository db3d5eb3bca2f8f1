"""All registered queries over the given tables, and their DuckDB twins."""

from __future__ import annotations

from . import graphs, rasters, scalars, scores  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "topo_report"
