"""Registered queries: every operator on the shared test tables, with its SQL twin."""

from .base import ORACLES, QUERIES


def load():
    from . import annotate, enrich, fields, learning, raster, tables  # noqa: F401

    return QUERIES, ORACLES


__all__ = ["load", "QUERIES", "ORACLES"]
