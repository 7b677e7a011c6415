"""Registered queries and the DuckDB SQL they are checked against."""

from logweir.queries.base import ORACLES, QUERIES
from logweir.queries import events, evaluation, features, incidents, models, streams, templates  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
