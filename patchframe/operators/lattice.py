"""Fields on the lattice patches were laid on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions.scalar import half_up, taper


def lattice_meta(P: DataFrame) -> DataFrame:
    """Per slide: origin, step (smallest gap between distinct coordinates on either
    axis; the side when there is no gap) and size in cells."""
    def gaps(c):
        d = P.select("slide", F.col(c).alias("v")).distinct()
        w = W.partitionBy("slide").orderBy("v")
        return (
            d.withColumn("g", F.col("v") - F.lag("v").over(w))
            .groupBy("slide")
            .agg(F.min("g").alias(f"g{c}"), F.min("v").alias(f"o{c}"), F.max("v").alias(f"m{c}"))
        )

    side = P.groupBy("slide").agg(F.max("side").alias("side"))
    m = gaps("x").join(gaps("y"), "slide").join(side, "slide")
    step = F.least(F.coalesce("gx", "side"), F.coalesce("gy", "side"))
    size = lambda o, hi: (half_up((F.col(hi) - F.col(o)) / F.col("step")) + 1).cast("int")
    return (
        m.withColumn("step", step.cast("bigint"))
        .withColumn("cols", size("ox", "mx"))
        .withColumn("rows", size("oy", "my"))
        .select("slide", F.col("ox").alias("origin_x"), F.col("oy").alias("origin_y"), "step", "cols", "rows")
    )


def lattice_of(P: DataFrame, order: str = "patch_id") -> DataFrame:
    """Cell of every patch; where two share a cell the later one holds it.  A cell
    without a row had nothing run on it."""
    meta = lattice_meta(P)
    cell = lambda c, o: half_up((F.col(c) - F.col(o)) / F.col("step")).cast("int")
    return (
        P.join(meta, "slide")
        .withColumns({"cx": cell("x", "origin_x"), "cy": cell("y", "origin_y")})
        .groupBy("slide", "cx", "cy")
        .agg(F.max_by("patch_id", order).alias("patch_id"))
    )


def _cells_under(P: DataFrame, cell: float) -> DataFrame:
    origin = P.groupBy("slide").agg(F.min("x").alias("__ox"), F.min("y").alias("__oy"))
    c = float(cell)
    half = F.col("side") / 2
    first = lambda v, o: F.floor((F.col(v) - F.col(o)) / c).cast("int")
    last = lambda v, o: (F.ceil((F.col(v) + F.col("side") - F.col(o)) / c) - 1).cast("int")
    d = (
        P.join(origin, "slide")
        .withColumn("row", F.explode(F.sequence(first("y", "__oy"), last("y", "__oy"))))
        .withColumn("col", F.explode(F.sequence(first("x", "__ox"), last("x", "__ox"))))
    )
    dx = F.col("__ox") + (F.col("col") + 0.5) * c - (F.col("x") + half)
    dy = F.col("__oy") + (F.col("row") + 0.5) * c - (F.col("y") + half)
    return d.withColumn("w", taper(dx, dy, half))


def blend(P: DataFrame, probs: DataFrame, cell: float) -> DataFrame:
    """``slide, col, row, class, prob``: overlapping patches averaged per raster cell,
    each weighted by a raised cosine of its distance from the cell.

    ``probs`` is long (slide, patch_id, class, prob).
    """
    d = _cells_under(P.select("slide", "patch_id", "x", "y", "side"), cell)
    return (
        d.join(probs, ["slide", "patch_id"])
        .groupBy("slide", "col", "row", "class")
        .agg((F.sum(F.col("w") * F.col("prob")) / F.sum("w")).alias("prob"))
    )


def blend_field(P: DataFrame, field: DataFrame, mask: DataFrame | None = None, cell: float | None = None,
                min_mask: float = 0.5, keep_blank: bool = False) -> DataFrame:
    """Blend one value per patch, with the tissue mask riding along.

    Cells whose blended mask is under ``min_mask`` are blank.  ``keep_blank`` returns
    them too, with ``shown`` false: a display range is taken over all cells.
    """
    f = field.select("slide", "patch_id", "value")
    if mask is not None:
        f = f.join(mask.select("slide", "patch_id", F.col("in_tissue").cast("double").alias("m")), ["slide", "patch_id"])
    else:
        f = f.withColumn("m", F.lit(1.0))
    d = _cells_under(P.select("slide", "patch_id", "x", "y", "side"), cell)
    out = (
        d.join(f, ["slide", "patch_id"])
        .groupBy("slide", "col", "row")
        .agg(
            (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"),
            (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("coverage"),
        )
        .withColumn("shown", F.col("coverage") >= min_mask)
    )
    return out if keep_blank else out.filter("shown").drop("shown")
