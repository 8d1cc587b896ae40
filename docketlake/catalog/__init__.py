"""Every operator as a query over the driver tables, most with equivalent SQL."""

from docketlake.catalog import (  # noqa: F401
    conversions,
    extensions,
    filters,
    functions,
    ingest,
    quality,
    relations,
    searches,
    sets,
    statistics,
    storage,
    streams,
    windows,
)
from docketlake.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
