"""All queries of the library by name, with DuckDB SQL that must give the same rows."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
