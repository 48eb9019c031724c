"""Locally consistent grammars over string collections, as Spark tables."""

__version__ = "0.1.0"
