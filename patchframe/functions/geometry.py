"""Geometry as column expressions.

A geometry is ``ARRAY<ARRAY<ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>>>``: polygons, each a
list of rings (outer first), each a list of points.  Points and lines use the same
nesting with one ring and say what they are in ``geom_type``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY_TYPE = "array<array<array<struct<x:double,y:double>>>>"
EDGE_TYPE = "array<array<struct<x1:double,y1:double,x2:double,y2:double>>>"
AREA_TYPES = ("Polygon", "MultiPolygon")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pt(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def is_area(geom_type="geom_type") -> Column:
    return _col(geom_type).isin(*AREA_TYPES)


def vertices(polygons) -> Column:
    return F.flatten(F.flatten(_col(polygons)))


def ring_pairs(ring) -> Column:
    """Each vertex with the one before it (the first with the last)."""
    ring = _col(ring)
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, F.greatest(n - 1, F.lit(0))))
    return F.when(n < 1, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).otherwise(
        F.zip_with(
            before, ring,
            lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
        )
    )


def edges_of(polygons) -> Column:
    """Per polygon, the non-horizontal edges of all its rings.  Compute once per region."""
    return F.transform(
        _col(polygons),
        lambda poly: F.filter(F.flatten(F.transform(poly, ring_pairs)), lambda e: e.y1 != e.y2),
    )


def edges_contain(edges, x, y) -> Column:
    """Even-odd rule over every ring of a polygon, any polygon of the geometry."""
    x, y = _col(x).cast("double"), _col(y).cast("double")

    def crosses(e):
        at = (e.x1 - e.x2) * (y - e.y2) / (e.y1 - e.y2) + e.x2
        return ((e.y2 > y) != (e.y1 > y)) & (x < at)

    return F.exists(_col(edges), lambda poly: F.size(F.filter(poly, crosses)) % 2 == 1)


def contains_point(polygons, x, y) -> Column:
    return edges_contain(edges_of(polygons), x, y)


def ring_area(ring) -> Column:
    """Shoelace, signed."""
    return F.aggregate(
        ring_pairs(ring), F.lit(0.0), lambda a, e: a + (e.x1 - e.x2) * (e.y1 + e.y2)
    ) / 2


def area(polygons, geom_type=None) -> Column:
    """Area with holes subtracted; zero for points and lines when the kind is given."""

    def one(poly):
        sizes = F.transform(poly, lambda r: F.abs(ring_area(r)))
        total = F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(sizes) > 0, F.get(sizes, F.lit(0)) * 2 - total).otherwise(0.0)

    a = F.aggregate(F.transform(_col(polygons), one), F.lit(0.0), lambda s, v: s + v)
    return a if geom_type is None else F.when(is_area(geom_type), a).otherwise(0.0)


def bbox(polygons) -> dict[str, Column]:
    pts = vertices(polygons)
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return {
        "minx": F.array_min(xs), "miny": F.array_min(ys),
        "maxx": F.array_max(xs), "maxy": F.array_max(ys),
    }


def with_bbox(df: DataFrame, polygons: str = "polygons") -> DataFrame:
    return df.withColumns(bbox(polygons))


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; a segment of no length is its point."""
    x, y, ax, ay, bx, by = (_col(c) for c in (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.when(len2 != 0, len2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def _segments(ring) -> Column:
    n = F.size(ring)
    return F.when(n == 1, F.zip_with(ring, ring, lambda a, b: F.struct(
        a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))).otherwise(
        F.zip_with(
            F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
        )
    )


def segments_of(polygons) -> Column:
    """The segments of all rings."""
    return F.flatten(F.transform(F.flatten(_col(polygons)), _segments))


def distance_to_geometry(polygons, x, y, geom_type=None) -> Column:
    """Smallest distance to any segment.  A point inside an area still measures to
    its outline, which is what a click near a border asks for."""
    return F.array_min(
        F.transform(segments_of(polygons), lambda s: segment_distance(x, y, s.x1, s.y1, s.x2, s.y2))
    )


def close_ring(ring) -> Column:
    ring = _col(ring)
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(
        (first.x == last.x) & (first.y == last.y), ring
    ).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def rect_ring(x0, y0, x1, y1) -> Column:
    """Closed ring of an axis-aligned rectangle, whichever corners are given."""
    x0, y0, x1, y1 = (_col(c) for c in (x0, y0, x1, y1))
    lx, hx, ly, hy = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    return F.array(_pt(lx, ly), _pt(hx, ly), _pt(hx, hy), _pt(lx, hy), _pt(lx, ly))


def circle_ring(cx, cy, radius, segments: int = 32) -> Column:
    cx, cy, radius = (_col(c) for c in (cx, cy, radius))
    step = 2 * math.pi / segments
    return close_ring(
        F.transform(
            F.sequence(F.lit(0), F.lit(segments - 1)),
            lambda i: _pt(cx + radius * F.cos(i * step), cy + radius * F.sin(i * step)),
        )
    )


def translate(polygons, dx, dy) -> Column:
    dx, dy = _col(dx), _col(dy)
    return F.transform(
        _col(polygons),
        lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: _pt(p.x + dx, p.y + dy))),
    )


def _finite(v) -> Column:
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def all_finite(polygons) -> Column:
    return F.forall(vertices(polygons), lambda p: _finite(p.x) & _finite(p.y))


def is_degenerate(polygons, geom_type=None) -> Column:
    """A coordinate that is no number, or an area none of whose outlines has four points."""
    usable = F.exists(_col(polygons), lambda poly: F.coalesce(F.size(F.get(poly, F.lit(0))), F.lit(0)) >= 4)
    short = ~usable if geom_type is None else is_area(geom_type) & ~usable
    return ~all_finite(polygons) | short


def _ring_finite(ring) -> Column:
    return F.forall(ring, lambda p: _finite(p.x) & _finite(p.y))


def valid_rings(rings) -> Column:
    """One polygon's rings with the unusable holes dropped; null without a usable outline.

    A hole goes when it is too short, not finite, or when its mean vertex lies
    outside the outline.
    """
    rings = _col(rings)
    outer = F.get(rings, F.lit(0))

    def keep(hole):
        n = F.size(hole).cast("double")
        mx = F.aggregate(hole, F.lit(0.0), lambda a, p: a + p.x) / F.when(n > 0, n)
        my = F.aggregate(hole, F.lit(0.0), lambda a, p: a + p.y) / F.when(n > 0, n)
        inside = F.size(F.filter(ring_pairs(outer), lambda e: (
            ((e.y2 > my) != (e.y1 > my))
            & (mx < (e.x1 - e.x2) * (my - e.y2) / F.when(e.y1 != e.y2, e.y1 - e.y2) + e.x2)
        ))) % 2 == 1
        return (F.size(hole) >= 4) & _ring_finite(hole) & inside

    holes = F.filter(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), keep)
    return F.when((F.size(outer) >= 4) & _ring_finite(outer), F.concat(F.slice(rings, 1, 1), holes))


def square_polygons(x, y, side) -> Column:
    """A patch as a one-ring polygon geometry."""
    x, y, side = _col(x), _col(y), _col(side)
    return F.array(F.array(rect_ring(x, y, x + side, y + side)))
