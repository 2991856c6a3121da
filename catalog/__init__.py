"""Every operator as a query over the given tables, with equivalent SQL where it can be written."""

from catalog import compare, exports, filters, grouping, ordering, profiles, sources, tables  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
