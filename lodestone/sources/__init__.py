"""Readers for the tables the queries run on."""

from lodestone.sources.tables import table

__all__ = ["table"]
