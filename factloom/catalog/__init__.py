"""Registry of the core queries and of the SQL that states the same results."""

from factloom.catalog import access, aggregates, contextual, exchange, graphs, joins, language, model, stored, templated, tools, university  # noqa: F401
from factloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
