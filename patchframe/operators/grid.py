"""Laying, filtering and counting patch grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchframe.functions.geometry import square_polygons
from patchframe.functions.scalar import half_up

from .expression import beside
from .joins import filter_patches
from .stats import row_numbers


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def grid_meta(regions: DataFrame, patch_px, stride_px=None, downsample=1.0, mpp=None) -> DataFrame:
    """Whole-pixel geometry of each region's grid (``slide, region_id, x, y, width, height``)."""
    px = F.greatest(F.lit(8), half_up(_c(patch_px)))
    st = F.greatest(F.lit(1), half_up(_c(stride_px if stride_px is not None else patch_px)))
    ds = _c(downsample).cast("double")
    um = F.lit(None).cast("double") if mpp is None else px * ds * _c(mpp)
    g = regions.withColumns(
        {
            "patch_px": px.cast("int"), "stride_px": st.cast("int"),
            "side": F.greatest(F.lit(1), half_up(px * ds)).cast("int"),
            "step": F.greatest(F.lit(1), half_up(st * ds)).cast("int"),
            "ox": half_up("x").cast("bigint"), "oy": half_up("y").cast("bigint"),
            "patch_um": um,
        }
    )
    count = lambda size: F.greatest(F.lit(0), F.floor((F.col(size) - F.col("side")) / F.col("step")) + 1).cast("int")
    return g.withColumns({"cols": count("width"), "rows": count("height")})


def build_patch_grid(
    regions: DataFrame, patch_px, stride_px=None, downsample=1.0, mpp=None,
    within: DataFrame | None = None, restrict_to: DataFrame | None = None, bounded: bool = False,
) -> DataFrame:
    """Patches of every region's grid, in whole level-0 pixels.

    ``bounded`` drops patches that leave the slide's ``bx, by, bw, bh`` columns.
    ``index`` is renumbered row by row after filtering, per region.  Rows are the
    ordering buckets, so numbering a slide never sorts it in one task.
    """
    meta = grid_meta(regions, patch_px, stride_px, downsample, mpp).filter("cols > 0 and rows > 0")
    p = (
        meta.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
        .withColumn("px", F.col("ox") + F.col("col").cast("bigint") * F.col("step"))
        .withColumn("py", F.col("oy") + F.col("row").cast("bigint") * F.col("step"))
    )
    if bounded:
        p = p.filter(
            (F.col("px") >= F.col("bx")) & (F.col("py") >= F.col("by"))
            & (F.col("px") + F.col("side") <= F.col("bx") + F.col("bw"))
            & (F.col("py") + F.col("side") <= F.col("by") + F.col("bh"))
        )
    p = p.select(
        "slide", "region_id", "col", "row", F.col("px").alias("x"), F.col("py").alias("y"), "side",
        "patch_um",
    )
    if within is not None or restrict_to is not None:
        p = p.withColumn("patch_id", F.struct("region_id", "row", "col"))
        p = filter_patches(p, within, restrict_to).drop("patch_id")
    return row_numbers(p, ["slide", "region_id"], F.col("row"), [F.col("row"), F.col("col")], "index")


def pool_grids(*grids: DataFrame) -> DataFrame:
    """Several regions' grids as one set, each patch remembering its region; numbered
    by region, then row by row."""
    every = grids[0]
    for g in grids[1:]:
        every = every.unionByName(g)
    d = every.withColumnRenamed("region_id", "roi_id")
    bucket = F.struct(F.col("roi_id"), F.col("row"))
    return row_numbers(d.drop("index"), "slide", bucket, [F.col("roi_id"), F.col("row"), F.col("col")], "patch_id")


def prefix_table(M: DataFrame, value="m") -> DataFrame:
    """Inclusive 2-D prefix sums of a dense cell mask (slide, x, y, value)."""
    from pyspark.sql import Window as W

    across = W.partitionBy("slide", "y").orderBy("x")
    down = W.partitionBy("slide", "x").orderBy("y")
    return (
        M.withColumn("__r", F.sum(F.col(value).cast("bigint")).over(across))
        .select("slide", "x", "y", F.sum("__r").over(down).alias("s"))
    )


def tissue_patches(P: DataFrame, M: DataFrame, extent: DataFrame, min_fraction: float = 0.25) -> DataFrame:
    """Patches with at least this share of tissue among the overview cells under them.

    ``extent`` has slide, width, height (slide pixels) and tw, th (cells).  Four
    corners of a prefix-sum table give each patch its count, whatever its size.  Patches
    may come from an exploded grid the planner takes to be small, so they are not broadcast.
    """
    lo = lambda c, full, cells: F.floor(F.col(c) / F.col(full) * F.col(cells)).cast("int")
    hi = lambda c, full, cells: F.floor((F.col(c) + F.col("side")) / F.col(full) * F.col(cells)).cast("int")
    p = (
        beside(P, extent)
        .withColumns({"x0": lo("x", "width", "tw"), "y0": lo("y", "height", "th")})
        .withColumns(
            {
                "x1": F.least(F.col("tw"), F.greatest(F.col("x0") + 1, hi("x", "width", "tw"))),
                "y1": F.least(F.col("th"), F.greatest(F.col("y0") + 1, hi("y", "height", "th"))),
            }
        )
    )
    corner = lambda cx, cy, sign: F.struct(
        (F.col(cx) - 1).alias("cx"), (F.col(cy) - 1).alias("cy"), F.lit(sign).alias("sign")
    )
    corners = F.array(
        corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1)
    )
    cells = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    asked = p.select("slide", "patch_id", cells.alias("cells"), F.explode(corners).alias("c"))
    asked = asked.select("slide", "patch_id", "cells", F.col("c.cx").alias("x"), F.col("c.cy").alias("y"), "c.sign")
    frac = (
        asked.hint("merge").join(prefix_table(M), ["slide", "x", "y"], "left")
        .groupBy("slide", "patch_id")
        .agg((F.sum(F.col("sign") * F.coalesce("s", F.lit(0))) / F.first("cells")).alias("tissue_fraction"))
        .filter(F.col("tissue_fraction") >= min_fraction)
    )
    return P.hint("merge").join(frac, ["slide", "patch_id"])


def pick_level(slides: DataFrame, target_mpp: float | None, mode: str = "nearest") -> DataFrame:
    """Pyramid level for a scale: ``nearest`` (ties to the finer one) or the
    ``coarsest`` still within 1 % of it.  Level 0 when no scale is known."""
    l = slides.select("slide", "mpp", F.explode("levels").alias("l"))
    scale = F.col("l.downsample") * F.col("mpp")
    if target_mpp is None:
        return slides.select("slide", F.lit(0).alias("level"))
    if mode == "nearest":
        err = F.round(F.abs(scale - target_mpp), 9)
        pick = F.min_by(F.col("l.level"), F.struct(err, F.col("l.level")))
        known = F.max("mpp").isNotNull()
        return l.groupBy("slide").agg(F.when(known, pick).otherwise(0).alias("level"))
    fits = F.max(F.when(scale <= target_mpp * 1.01, F.col("l.level")))
    return l.groupBy("slide").agg(F.coalesce(fits, F.lit(0)).alias("level"))


def estimate_patches(R: DataFrame, patch_px: int, stride_fraction: float = 1.0, downsample: float = 1.0,
                     ms_per_patch: float | None = None) -> DataFrame:
    """How many patches the regions' boxes hold, and how long they would take."""
    side = patch_px * downsample
    step = max(1, int(patch_px * stride_fraction + 0.5)) * downsample
    n = lambda lo, hi: F.greatest(F.lit(0), F.floor((F.col(hi) - F.col(lo) - side) / step) + 1)
    e = R.groupBy("slide").agg(F.sum(n("minx", "maxx") * n("miny", "maxy")).cast("bigint").alias("patches"))
    ms = F.lit(None).cast("double") if ms_per_patch is None else F.col("patches") * float(ms_per_patch)
    return e.withColumn("estimated_ms", ms)


def patch_squares(P: DataFrame, class_id: Column, source: str = "model", model_id: str | None = None) -> DataFrame:
    """Grid cells as polygon annotations."""
    side = F.col("side").cast("double")
    return P.select(
        "slide", F.concat_ws("-", F.lit("patch"), F.col("slide"), F.col("patch_id").cast("string")).alias("id"),
        F.lit("Polygon").alias("geom_type"), square_polygons("x", "y", side).alias("polygons"),
        class_id.alias("class_id"), F.lit("annotation").alias("object_type"), F.lit(source).alias("source"),
        F.lit(model_id).cast("string").alias("model_id"), F.lit(False).alias("locked"),
    )
