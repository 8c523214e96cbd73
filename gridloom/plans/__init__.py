"""Registered queries; importing the package registers them."""

from . import map_queries, queries  # noqa: F401
