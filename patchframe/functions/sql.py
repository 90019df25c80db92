"""The two functions SQL users ask for, as SQL functions (no Python in the query)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import GEOMETRY_TYPE
from .scalar import ERFC_COEFFICIENTS


def register_functions(spark: SparkSession) -> None:
    """Make ``normal_sf(z)`` and ``contains_point(polygons, x, y)`` known to ``spark.sql``."""
    t = "(1D / (1D + 0.5D * abs(z) / sqrt(2D)))"
    poly = f"{ERFC_COEFFICIENTS[0]}D"
    for c in ERFC_COEFFICIENTS[1:]:
        poly = f"({poly} * {t} + ({c}D))"
    tail = f"{t} * exp({poly} - z * z / 2D)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normal_sf(z DOUBLE) RETURNS DOUBLE "
        f"RETURN CASE WHEN z >= 0 THEN {tail} ELSE 2D - {tail} END / 2D"
    )
    # Each vertex with the one before it; horizontal edges never cross.
    before = "element_at(r, CASE WHEN i = 0 THEN size(r) ELSE i END)"
    crosses = (
        f"(p.y > py) <> ({before}.y > py) AND px < ({before}.x - p.x) * (py - p.y) "
        f"/ nullif({before}.y - p.y, 0D) + p.x"
    )
    odd = f"aggregate(poly, 0, (n, r) -> n + size(filter(r, (p, i) -> {crosses}))) % 2 = 1"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION contains_point(polygons {GEOMETRY_TYPE}, px DOUBLE, py DOUBLE) "
        f"RETURNS BOOLEAN RETURN exists(polygons, poly -> {odd})"
    )
