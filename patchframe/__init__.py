"""Spatial-map analytics as Spark DataFrame operators, keyed by slide."""

__version__ = "0.1.0"
