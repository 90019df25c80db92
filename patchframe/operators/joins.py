"""Spatial and key joins.

Point-in-region joins are equi joins on (slide, tile) with the exact test as a
residual condition.  The optimiser broadcasts a side only while it measures small;
beyond that the same plan shuffles on (slide, tile), so a slide that holds most of
the patches is spread over its tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchframe.functions import geometry as geo

from .components import cut_lineage
from .expression import SMALL_BYTES, beside, is_small

TILE = 4096.0
PAIRS = 20_000  # points and segments of a tile that are compared without looking for fewer


def centre(side="side") -> tuple[Column, Column]:
    half = F.col(side) / 2
    return F.col("x") + half, F.col("y") + half


def _tile(c, tile) -> Column:
    return F.floor(c / F.lit(float(tile))).cast("bigint")


def _tile_for(boxes: DataFrame, grow: float, parts: int, most: float) -> float:
    """Tile that cuts boxes, grown by a distance, into about ``parts`` tiles each on average, ``most`` at most."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + 2 * grow
    mean = boxes.agg(F.avg(side * side)).first()[0]
    return min(most, math.sqrt(mean / parts)) if mean and math.isfinite(mean) else most


def _spread(regions: DataFrame) -> DataFrame:
    """Regions over all tasks: a small file is read by one, which would cut every region into tiles."""
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.repartition(n, "slide", "id")


def region_tiles(regions: DataFrame, *keep: str, tile: float = TILE) -> DataFrame:
    """Area regions, one row per tile their box reaches, with the edges that can
    decide a point of that tile."""
    r = geo.with_bbox(regions.filter(geo.is_area()).select("slide", "geom_type", "polygons", *keep))
    r = r.withColumn("__edges", geo.edges_of("polygons"))
    span = lambda lo, hi: F.sequence(_tile(F.col(lo), tile), _tile(F.col(hi), tile))
    r = r.withColumn("__ty", F.explode(span("miny", "maxy")))
    low, high = F.col("__ty") * tile, (F.col("__ty") + 1) * tile
    band = F.transform(
        "__edges",
        lambda poly: F.filter(
            poly, lambda e: (F.greatest(e.y1, e.y2) >= low) & (F.least(e.y1, e.y2) <= high)
        ),
    )
    return (
        r.withColumn("__edges", band)
        .withColumn("__tx", F.explode(span("minx", "maxx")))
        .select(
            F.col("slide").alias("__slide"), "__tx", "__ty", "__edges",
            "minx", "miny", "maxx", "maxy", *keep,
        )
    )


def points_in_regions(
    points: DataFrame, regions: DataFrame, *keep: str, x=None, y=None, how: str = "inner",
    tile: float = TILE,
) -> DataFrame:
    """Join points to the area regions that contain them.  ``x`` and ``y`` default to
    the centre of a patch."""
    if x is None:
        x, y = centre()
    return _points_in_tiles(points, region_tiles(regions, *keep, tile=tile), keep, x, y, how, tile)


def _points_in_tiles(points: DataFrame, r: DataFrame, keep, x, y, how: str, tile: float) -> DataFrame:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    p = points.withColumns({"__px": x.cast("double"), "__py": y.cast("double")}).withColumns(
        {"__ptx": _tile(F.col("__px"), tile), "__pty": _tile(F.col("__py"), tile)}
    )
    on = (
        (p["slide"] == r["__slide"])
        & (p["__ptx"] == r["__tx"]) & (p["__pty"] == r["__ty"])
        & (p["__px"] >= r["minx"]) & (p["__px"] <= r["maxx"])
        & (p["__py"] >= r["miny"]) & (p["__py"] <= r["maxy"])
        & geo.edges_contain(r["__edges"], p["__px"], p["__py"])
    )
    joined = p.join(r, on, how)
    out = list(points.columns) + (list(keep) if how in ("inner", "left") else [])
    return joined.select(*[F.col(c) for c in out])


def patches_inside(P: DataFrame, regions: DataFrame, tile: float = TILE) -> DataFrame:
    """Patches whose centre lies in any area region, each once."""
    return points_in_regions(P, regions, how="left_semi", tile=tile)


def flag_inside(P: DataFrame, regions: DataFrame, name: str = "inside", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Every patch with a boolean: is its centre in any area region.

    The regions are cut into tiles, written and measured.  While those are small they are
    broadcast and wide rows stay where they lie; beyond that the decision is made on the
    patch keys and a wide row takes part in one equi join on its key.
    """
    tiles = cut_lineage(region_tiles(regions))
    if is_small(tiles, small_bytes):
        region = F.struct("minx", "miny", "maxx", "maxy", "__edges")
        per_tile = tiles.groupBy("__slide", "__tx", "__ty").agg(F.collect_list(region).alias("__regions"))
        cx, cy = (c.cast("double") for c in centre())
        covers = lambda r: (
            (cx >= r["minx"]) & (cx <= r["maxx"]) & (cy >= r["miny"]) & (cy <= r["maxy"]) & geo.edges_contain(r["__edges"], cx, cy))
        at = (P["slide"] == per_tile["__slide"]) & (_tile(cx, TILE) == per_tile["__tx"]) & (_tile(cy, TILE) == per_tile["__ty"])
        flag = F.coalesce(F.exists("__regions", covers), F.lit(False))
        return P.join(F.broadcast(per_tile), at, "left").select(*[P[c] for c in P.columns if c != name], flag.alias(name))
    keys = patches_inside(P.select("slide", "patch_id", "x", "y", "side"), regions)
    hit = keys.select("slide", "patch_id", F.lit(True).alias(name))
    return P.drop(name).join(hit, ["slide", "patch_id"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def filter_patches(P: DataFrame, within: DataFrame | None = None, restrict_to: DataFrame | None = None) -> DataFrame:
    """Two independent filters.  A slide with no area region in a filter is not
    restricted by it."""
    for R in (within, restrict_to):
        if R is None:
            continue
        R = R.filter(geo.is_area())
        has = R.select("slide", F.lit(True).alias("__has")).distinct()
        keys = ["slide", "patch_id"]
        inside = patches_inside(P.select(*keys, "x", "y", "side"), R).select(*keys, F.lit(True).alias("__in"))
        P = (
            P.join(has, "slide", "left").join(inside, keys, "left")
            .filter(F.col("__has").isNull() | F.col("__in"))
            .drop("__has", "__in")
        )
    return P


def label_patches(P: DataFrame, R: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label by the first class, in list order, with a region over the patch centre.

    Patches in no region are left out, not called background.  The second table
    counts every class, also those that got nothing.
    """
    ranked = R.join(classes.select("class_id", "ordinal"), "class_id")
    labelled = (
        points_in_regions(P.select("slide", "patch_id", "x", "y", "side"), ranked, "ordinal")
        .groupBy("slide", "patch_id")
        .agg(F.min("ordinal").alias("label"))
    )
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per_class = classes.join(counts, classes["ordinal"] == counts["label"], "left").select(
        "ordinal", "class_id", F.coalesce("n", F.lit(0)).alias("n")
    )
    return labelled, per_class


def _smallest_over(sized: DataFrame, tile: float) -> DataFrame:
    """Tiles of regions (``id, __area``) without those that a smaller region hides, as it covers the whole tile."""
    rings = F.flatten(F.transform(F.flatten("polygons"), geo.ring_pairs))
    cut = region_tiles(_spread(sized).withColumn("__rings", rings), "id", "__area", "__rings", tile=tile)
    pad = tile * 1e-6
    x0, y0 = F.col("__tx") * tile, F.col("__ty") * tile
    meets = lambda e: (
        (F.greatest(e.x1, e.x2) >= x0 - pad) & (F.least(e.x1, e.x2) <= x0 + tile + pad)
        & (F.greatest(e.y1, e.y2) >= y0 - pad) & (F.least(e.y1, e.y2) <= y0 + tile + pad))
    whole = ~F.exists("__rings", meets) & geo.edges_contain("__edges", x0 + tile / 2, y0 + tile / 2)
    cut = cut_lineage(cut.withColumn("__whole", F.coalesce(whole, F.lit(False))).drop("__rings"))
    at = ["__slide", "__tx", "__ty"]
    best = cut.filter("__whole").groupBy(*at).agg(F.min(F.struct("__area", "id")).alias("__top"))
    return cut.join(best, at, "left").filter(F.col("__top").isNull() | (F.struct("__area", "id") <= F.col("__top"))).drop("__top", "__whole")


def hit_test(points: DataFrame, R: DataFrame, tolerance: float, tile: float | None = None) -> DataFrame:
    """Which annotation each point picks: a point annotation within ``tolerance``,
    otherwise the smallest area over it.  ``points`` has slide, point_id, px, py.

    Tiles are as small as the regions allow (about 32 a region); a region that covers a
    whole tile hides larger ones there, so stacked regions never meet the points.
    """
    dots = R.filter(F.col("geom_type") == "Point").select(
        "slide", "id", F.col("polygons")[0][0][0].alias("__d")
    )
    reach = F.sequence(F.lit(-1), F.lit(1))
    tol = float(max(tolerance, 1e-9))
    near = (
        points.withColumns({"__tx": _tile(F.col("px"), tol), "__ty": _tile(F.col("py"), tol)})
        .withColumn("__tx", F.explode(F.transform(reach, lambda d: F.col("__tx") + d)))
        .withColumn("__ty", F.explode(F.transform(reach, lambda d: F.col("__ty") + d)))
    )
    dots = dots.withColumns({"__tx": _tile(F.col("__d.x"), tol), "__ty": _tile(F.col("__d.y"), tol)})
    close = (
        near.join(dots, ["slide", "__tx", "__ty"])
        .filter(F.hypot(F.col("__d.x") - F.col("px"), F.col("__d.y") - F.col("py")) <= tolerance)
        .select("slide", "point_id", "id", F.lit(0).alias("__kind"), F.lit(0.0).alias("__area"))
    )
    sized = R.filter(geo.is_area()).withColumn("__area", geo.area("polygons"))
    tile = float(tile or _tile_for(geo.with_bbox(sized), 0.0, 32, TILE))
    under = _points_in_tiles(points, _smallest_over(sized, tile), ("id", "__area"), "px", "py", "inner", tile).select(
        "slide", "point_id", "id", F.lit(1).alias("__kind"), "__area"
    )
    return (
        close.unionByName(under)
        .groupBy("slide", "point_id")
        .agg(F.min(F.struct("__kind", "__area", "id")).alias("__best"))
        .select("slide", "point_id", F.col("__best.id").alias("id"))
    )


def query_box(R: DataFrame, boxes: DataFrame, unlocked_only: bool = False, tile: float = TILE) -> DataFrame:
    """Annotations whose bounding box meets a query box (``slide, box_id, bx0..by1``).

    Both sides meet on tiles; a pair is kept only in the tile that holds the corner
    of its overlap, so it comes out once without a distinct.
    """
    if unlocked_only:
        R = R.filter(~F.coalesce(F.col("locked"), F.lit(False)))
    b = geo.with_bbox(R.select("slide", "id", "polygons")).drop("polygons")
    span = lambda lo, hi: F.explode(F.sequence(_tile(F.col(lo), tile), _tile(F.col(hi), tile)))
    left = b.withColumn("__tx", span("minx", "maxx")).withColumn("__ty", span("miny", "maxy"))
    right = boxes.withColumn("__tx", span("bx0", "bx1")).withColumn("__ty", span("by0", "by1"))
    corner_x = _tile(F.greatest("minx", F.col("bx0").cast("double")), tile)
    corner_y = _tile(F.greatest("miny", F.col("by0").cast("double")), tile)
    return (
        left.join(right, ["slide", "__tx", "__ty"])
        .filter(
            (F.col("minx") <= F.col("bx1")) & (F.col("maxx") >= F.col("bx0"))
            & (F.col("miny") <= F.col("by1")) & (F.col("maxy") >= F.col("by0"))
            & (F.col("__tx") == corner_x) & (F.col("__ty") == corner_y)
        )
        .select("slide", "box_id", "id")
    )


def patches_along(P: DataFrame, axes: DataFrame, half_width: float | None = None) -> DataFrame:
    """Patches in the corridor of an axis, with their position ``t`` along it.

    ``axes`` has slide, axis_id, ax, ay, bx, by and, unless ``half_width`` is given,
    width.  An axis without length has no corridor.  Axes come to the patches, see
    :func:`expression.beside`.
    """
    cx, cy = centre()
    width = F.lit(float(half_width)) if half_width is not None else F.col("width")
    a = axes.select(
        "slide", "axis_id", F.col("ax").alias("__ax"), F.col("ay").alias("__ay"),
        (F.col("bx") - F.col("ax")).alias("__dx"), (F.col("by") - F.col("ay")).alias("__dy"),
        width.alias("__w"),
    ).withColumn("__len2", F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))
    a = a.filter(F.col("__len2") > 0)
    px, py = cx - F.col("__ax"), cy - F.col("__ay")
    return (
        beside(P, a)
        .withColumn("t", (px * F.col("__dx") + py * F.col("__dy")) / F.col("__len2"))
        .filter((F.col("t") >= 0) & (F.col("t") <= 1))
        .filter(F.abs(px * F.col("__dy") - py * F.col("__dx")) / F.sqrt("__len2") <= F.col("__w"))
        .select(*P.columns, "axis_id", "t")
    )


def axes_of(R: DataFrame, width: float) -> DataFrame:
    """Axis annotations as segments: the first and last vertex of a line."""
    from patchframe.schema import AXIS_CLASS

    line = F.col("polygons")[0][0]
    return R.filter(
        (F.col("geom_type") == "LineString") & (F.col("class_id") == AXIS_CLASS) & (F.size(line) >= 2)
    ).select(
        "slide", F.col("id").alias("axis_id"),
        line[0].x.alias("ax"), line[0].y.alias("ay"),
        F.element_at(line, -1).x.alias("bx"), F.element_at(line, -1).y.alias("by"),
        F.lit(float(width)).alias("width"),
    )


def _segment_distances(x: np.ndarray, y: np.ndarray, S: np.ndarray) -> np.ndarray:
    """Distance of every point to every segment (ax, ay, bx, by), as :func:`geometry.segment_distance` has it."""
    x, y = x[:, None], y[:, None]
    ax, ay, dx, dy = S[:, 0], S[:, 1], S[:, 2] - S[:, 0], S[:, 3] - S[:, 1]
    len2 = dx * dx + dy * dy
    t = ((x - ax) * dx + (y - ay) * dy) / np.where(len2 != 0, len2, 1.0)
    t = np.clip(np.where(len2 != 0, t, 0.0), 0.0, 1.0)
    out = np.hypot(x - (ax + t * dx), y - (ay + t * dy))
    out[np.isnan(out)] = np.inf
    return out


def closest(x: np.ndarray, y: np.ndarray, S: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, segment and distance of the nearest segments within ``d`` of each point, all of them if several are as near.

    Points are halved along their longer side until few are left.  Distance changes by no more
    than the way to the middle, so a segment farther from the middle than the nearest one by
    a diagonal of the points' box is nearest to none of them and is dropped on the way.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    slack = 1e-9 * (1 + max((np.abs(v[np.isfinite(v)]).max(initial=0.0) for v in (x, y, S)), default=0.0))
    todo = [(np.arange(len(x)), np.arange(len(S)))] if len(x) and len(S) else []
    while todo:
        at, of = todo.pop()
        px, py = x[at], y[at]
        wide, high = np.ptp(px), np.ptp(py)
        same = wide == 0 and high == 0
        if same or len(at) * len(of) <= PAIRS:
            D = _segment_distances(px[:1] if same else px, py[:1] if same else py, S[of])
            near = D.min(axis=1)
            row, col = np.nonzero((D == near[:, None]) & (near <= d)[:, None])
            if same:
                row, col = np.repeat(np.arange(len(at)), len(col)), np.tile(col, len(at))
            found.append((at[row], of[col], near[0 if same else row] + np.zeros(len(row))))
            continue
        half = np.hypot(wide, high) / 2
        c = _segment_distances(np.array([px.min() + wide / 2]), np.array([py.min() + high / 2]), S[of])[0]
        of = of[c <= min(c.min() + 2 * half, d + half) + slack]
        if len(of):
            order = np.argpartition(px if wide >= high else py, len(at) // 2)
            todo += [(at[order[: len(at) // 2]], of), (at[order[len(at) // 2 :]], of)]
    return tuple(np.concatenate(v) for v in zip(*found))


def _in_reach(R: DataFrame, d: float, tile: float) -> DataFrame:
    """Regions once per tile within ``d`` of them, with the segments that are (``ax, ay, bx, by``)."""
    r = _spread(geo.with_bbox(R.filter("slide IS NOT NULL")))
    span = lambda lo, hi: F.explode(F.sequence(_tile(F.col(lo) - d, tile), _tile(F.col(hi) + d, tile)))
    r = r.withColumn("__s", geo.segments_of("polygons")).select("slide", "id", "__s", "miny", "maxy", span("minx", "maxx").alias("__tx"))
    r = r.withColumn("__ty", span("miny", "maxy"))
    pad = d + tile * 1e-6
    x0, y0 = F.col("__tx") * tile, F.col("__ty") * tile
    meets = lambda s: (
        (F.greatest(s.x1, s.x2) >= x0 - pad) & (F.least(s.x1, s.x2) <= x0 + tile + pad)
        & (F.greatest(s.y1, s.y2) >= y0 - pad) & (F.least(s.y1, s.y2) <= y0 + tile + pad))
    r = r.withColumn("__s", F.filter("__s", meets)).filter(F.size("__s") > 0)
    part = lambda c: F.transform("__s", lambda s: s[c])
    return r.select("slide", "__tx", "__ty", "id", part("x1").alias("ax"), part("y1").alias("ay"), part("x2").alias("bx"), part("y2").alias("by"))


def nearest_region(points: DataFrame, R: DataFrame, max_distance: float, tile: float | None = None) -> DataFrame:
    """Nearest annotation within ``max_distance`` of each point (slide, point_id, px, py).

    Segments of outlines meet the points on tiles about half as wide as the regions with the
    distance around them; within a tile :func:`closest` compares the points with what can be
    nearest to them only, however many regions lie on each other.
    """
    d = float(max_distance)
    r = R.select("slide", "id", "polygons")
    tile = float(tile or _tile_for(geo.with_bbox(r), d, 4, max(TILE, 2 * d)))
    at = ["slide", "__tx", "__ty"]
    p = points.select("slide", "point_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).filter(
        "slide IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL")
    p = p.withColumns({"__tx": _tile(F.col("px"), tile), "__ty": _tile(F.col("py"), tile)})
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [right[c].combine_chunks() for c in ("ax", "ay", "bx", "by")]
        S = np.stack([np.asarray(v.flatten(), np.float64) for v in lists], axis=1)
        region = np.repeat(np.arange(len(right)), np.asarray(lists[0].value_lengths()))
        point, segment, distance = closest(np.asarray(left["px"]), np.asarray(left["py"]), S, d)
        return pa.table({"slide": left["slide"].take(point), "point_id": left["point_id"].take(point),
                         "id": right["id"].take(region[segment]), "distance": distance})

    schema = f"slide {kind(p, 'slide')}, point_id {kind(p, 'point_id')}, id {kind(r, 'id')}, distance double"
    found = p.groupBy(*at).cogroup(_in_reach(r, d, tile).groupBy(*at)).applyInArrow(near, schema)
    return (
        found.groupBy("slide", "point_id")
        .agg(F.min(F.struct("distance", "id")).alias("__m"))
        .select("slide", "point_id", F.col("__m.id").alias("id"), F.col("__m.distance").alias("distance"))
    )


def missing_keys(wanted: DataFrame, have: DataFrame, key: str = "patch_key") -> DataFrame:
    """What is still to be done: an anti join on the key."""
    return wanted.join(have.select(key), key, "left_anti")


def gene_vocabulary(wanted: DataFrame, G: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of a ``slide, gene`` request list against the maps."""
    have = G.select("slide", "gene")
    return wanted.join(have, ["slide", "gene"], "left_semi"), wanted.join(have, ["slide", "gene"], "left_anti")


def match_maps(maps: DataFrame, slides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps (``map_slide``) whose recorded slide exists (``name``), and the refused ones."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]+$", ""))
    m = maps.withColumn("__k", key(F.col("map_slide")))
    s = slides.withColumn("__k", key(F.col("name")))
    return m.join(s, "__k").drop("__k"), m.join(s, "__k", "left_anti").drop("__k")
