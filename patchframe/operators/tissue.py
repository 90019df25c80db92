"""Finding tissue on overview cells, and the samples a tissue model is trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions.scalar import half_up

from . import components as cc
from . import contour, raster
from .joins import points_in_regions
from .stats import row_numbers

# Defaults of the detector.
SEAM_RADIUS, BIND_RADIUS = 1, 3
MAX_HOLE_UM2, MAX_ASPECT, MIN_WIDTH_UM = 200_000.0, 10.0, 400.0
MIN_CELLS, UNSCALED_HOLE_SHARE = 16, 0.002
# Sampling of labelled cells and of glass.
MAX_PER_REGION, BACKGROUND_SAMPLES, BACKGROUND_REGIONS = 4000, 3000, 8


def grid_of(C: DataFrame, slides: DataFrame) -> DataFrame:
    """Per slide: cells across and down, cell size in slide pixels and micrometres.

    ``slides`` has slide, ox, oy, span_x, span_y (slide pixels the overview covers)
    and mpp (null when unknown).
    """
    size = C.groupBy("slide").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return size.join(slides.select("slide", "ox", "oy", "span_x", "span_y", "mpp"), "slide").withColumns(
        {
            "sx": F.col("span_x") / F.col("w"), "sy": F.col("span_y") / F.col("h"),
            "um_per_cell": F.col("span_x") / F.col("w") * F.col("mpp"),
        }
    )


def tissue_masks(C: DataFrame, levels: DataFrame | None = None, probability: DataFrame | None = None,
                 threshold: float = 0.5, saturation: float | None = None, seam_radius: int = SEAM_RADIUS,
                 bind_radius: int = BIND_RADIUS) -> DataFrame:
    """Dense masks ``strong`` (where tissue starts) and ``weak`` (how far it may grow).

    From colour, or from a model's probability per cell.  Opening deletes seams
    before closing binds the islands of one section.
    """
    if probability is not None:
        m = C.select("slide", "x", "y").join(probability, ["slide", "x", "y"]).select(
            "slide", "x", "y",
            (F.col("prob") >= threshold).cast("int").alias("strong"),
            (F.col("prob") >= threshold * 0.5).cast("int").alias("weak"),
        )
    else:
        scored = raster.tissue_score(C)
        cut = levels if levels is not None else raster.otsu_levels(scored)
        if saturation is not None:
            cut = cut.withColumn("relaxed", F.lit(int(saturation * 255 + 0.5)))
        m = scored.join(cut.select("slide", "relaxed", F.col("weak").alias("weak_level")), "slide").select(
            "slide", "x", "y",
            (F.col("score") > F.col("relaxed")).cast("int").alias("strong"),
            (F.col("score") > F.col("weak_level")).cast("int").alias("weak"),
        )
    m = raster.sweeps(m, ["strong", "weak"], [("erode", seam_radius), ("dilate", seam_radius)])
    return raster.sweeps(m, ["strong"], [("dilate", bind_radius), ("erode", bind_radius)])


def tissue_fragments(masks: DataFrame, tile: int = cc.TILE) -> DataFrame:
    """Labelled tissue cells: components of the strong mask grown into the weak one."""
    masks = cc.cut_lineage(masks)
    seeds = cc.label_components(masks.select("slide", "x", "y", F.col("strong").alias("m")), tile)
    return cc.hysteresis_grow(seeds, masks.select("slide", "x", "y", F.col("weak").alias("m")), tile)


def solid_fragments(fragments: DataFrame, stats: DataFrame, grid: DataFrame, tile: int = cc.TILE) -> DataFrame:
    """Each fragment in its own window: closed by one cell, small gaps filled.

    A window is treated as a slide of its own (``slide`` becomes a fragment key), so
    two fragments never merge and a gap is only ever filled inside its fragment.
    """
    key = F.concat_ws("#", "slide", F.col("label").cast("string"))
    box = stats.join(grid.select("slide", "w", "h"), "slide").select(
        "slide", "label", "max_hole",
        F.greatest(F.lit(0), F.col("minx") - 2).alias("x0"), F.least(F.col("w") - 1, F.col("maxx") + 2).alias("x1"),
        F.greatest(F.lit(0), F.col("miny") - 2).alias("y0"), F.least(F.col("h") - 1, F.col("maxy") + 2).alias("y1"),
    )
    window = (
        box.withColumn("y", F.explode(F.sequence("y0", "y1")))
        .withColumn("x", F.explode(F.sequence("x0", "x1")))
        .select("slide", "label", "x", "y", "max_hole")
    )
    dense = window.join(
        cc.apart(fragments.withColumn("__on", F.lit(1))), ["slide", "label", "x", "y"], "left"
    ).select(key.alias("slide"), F.col("slide").alias("of"), "label", "x", "y", "max_hole",
             F.coalesce("__on", F.lit(0)).alias("m"))
    closed = cc.cut_lineage(raster.closing(dense, 1))
    return _fill(closed, tile).filter("m = 1").select(F.col("of").alias("slide"), "label", "x", "y")


def _fill(closed: DataFrame, tile: int) -> DataFrame:
    limit = closed.groupBy("slide").agg(F.max("max_hole").alias("__limit"))
    small = (
        cc.enclosed_gaps(closed.select("slide", "x", "y", "m"), tile)
        .join(cc.apart(limit), "slide").filter(F.col("cells") <= F.col("__limit"))
        .select("slide", "x", "y", F.lit(1).alias("__f"))
    )
    return closed.join(cc.apart(small), ["slide", "x", "y"], "left").withColumn("m", F.coalesce("__f", "m")).drop("__f")


def detect_tissue(
    C: DataFrame, slides: DataFrame, probability: DataFrame | None = None, model_id: str | None = None,
    min_area_um2: float | None = None, max_hole_um2: float = MAX_HOLE_UM2, max_aspect: float = MAX_ASPECT,
    min_width_um: float = MIN_WIDTH_UM, tolerance: float = 0.8, tile: int = cc.TILE, **mask_options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, cells, report) for a folder of slides at once.

    Regions are annotations in slide pixels, cells the labelled tissue before the
    outlines, the report one row per slide, also for slides where nothing was found.
    """
    grid = grid_of(C, slides)
    um2 = F.col("um_per_cell") * F.col("um_per_cell")
    least = F.lit(float(MIN_CELLS)) if min_area_um2 is None else F.coalesce(
        F.greatest(F.lit(4.0), F.lit(float(min_area_um2)) / um2), F.lit(float(MIN_CELLS)))
    hole = F.coalesce(
        F.greatest(F.lit(1), half_up(F.lit(float(max_hole_um2)) / um2)),
        F.greatest(F.lit(1), half_up(F.col("w") * F.col("h") * UNSCALED_HOLE_SHARE)),
    ).cast("bigint")
    grid = grid.withColumns({"min_cells": least, "max_hole": hole})

    fragments = tissue_fragments(tissue_masks(C, probability=probability, **mask_options), tile)
    stats = cc.component_stats(fragments).join(grid.select("slide", "min_cells", "max_hole"), "slide").filter(
        F.col("cells") >= F.col("min_cells"))
    solid = solid_fragments(fragments, stats, grid, tile).join(grid.select("slide", "min_cells"), "slide")
    rings = contour.trace_regions(solid, ["slide", "label"], "min_cells", tolerance).join(
        grid.select("slide", "ox", "oy", "sx", "sy", "um_per_cell"), "slide")
    rw = F.greatest(F.lit(1.0), F.col("maxx") - F.col("minx"))
    rh = F.greatest(F.lit(1.0), F.col("maxy") - F.col("miny"))
    strip = (F.greatest(rw, rh) / F.least(rw, rh) >= max_aspect) & F.coalesce(
        F.least(rw, rh) * F.col("um_per_cell") < min_width_um, F.lit(True))
    rings = cc.cut_lineage(rings.withColumn("artefact", strip))

    name = f"tissue-{model_id}" if model_id else "tissue-colour"
    regions = rings.filter(~F.col("artefact")).select(
        "slide",
        F.concat_ws("-", F.lit("tissue"), "slide", F.col("label").cast("string"), F.col("part").cast("string")).alias("id"),
        F.lit("Polygon").alias("geom_type"),
        F.array(contour.to_slide("rings", F.col("ox"), F.col("oy"), F.col("sx"), F.col("sy"))).alias("polygons"),
        F.lit("tissue").alias("class_id"), F.lit("model").alias("source"), F.lit(name).alias("model_id"),
        F.lit(False).alias("locked"),
    )
    found = fragments.groupBy("slide").agg(F.count(F.lit(1)).alias("n"))
    counted = rings.groupBy("slide").agg(
        F.sum((~F.col("artefact")).cast("bigint")).alias("regions"),
        F.sum(F.col("artefact").cast("bigint")).alias("rejected"),
    )
    report = grid.select("slide", "w", "h").join(found, "slide", "left").join(counted, "slide", "left").select(
        "slide", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
        (F.coalesce("n", F.lit(0)) / (F.col("w") * F.col("h"))).alias("coverage"),
    )
    return regions, fragments, report


def batch_report(listed: DataFrame, report: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """One row per listed slide: what was found, or why nothing was written.

    A bad slide is a row here and does not end the run.
    """
    d = listed.select("slide").join(report, "slide", "left")
    if rejects is not None:
        d = d.join(rejects.select("slide", "error"), "slide", "left")
    else:
        d = d.withColumn("error", F.lit(None).cast("string"))
    return d.withColumn("status", F.when(F.col("error").isNotNull(), "error")
                        .when(F.col("regions").isNull(), "missing").when(F.col("regions") == 0, "empty")
                        .otherwise("written"))


def pending_slides(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Slides without a result yet."""
    return listed.join(done.select("slide").distinct(), "slide", "left_anti")


def collect_samples(
    C: DataFrame, R: DataFrame, slides: DataFrame, background: bool = True,
    max_per_region: int = MAX_PER_REGION, background_samples: int = BACKGROUND_SAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """(samples, skipped regions) for training a tissue model.

    ``R`` are area regions with ``label`` 1 (tissue) or 0 (artefact).  A cell belongs
    to a region by its centre.  Each region is one validation group and gives at most
    ``max_per_region`` cells, evenly spaced; glass gives eight groups.
    """
    grid = grid_of(C, slides)
    at = C.select("slide", "x", "y").join(grid.select("slide", "ox", "oy", "sx", "sy"), "slide").withColumns(
        {"px": F.col("ox") + (F.col("x") + 0.5) * F.col("sx"), "py": F.col("oy") + (F.col("y") + 0.5) * F.col("sy")})
    hit = points_in_regions(at, R, "id", "label", x="px", y="py").select("slide", "id", "label", "x", "y")
    sizes = hit.groupBy("slide", "id", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.withColumn(
        "group", F.row_number().over(W.partitionBy("slide").orderBy(F.desc("label"), "id")) - 1)
    placed = row_numbers(hit, ["slide", "id"], F.col("y"), [F.col("y"), F.col("x")], "k")
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / max_per_region))
    taken = placed.join(groups.drop("label"), ["slide", "id"]).filter(F.col("k") % stride == 0)
    samples = taken.select("slide", "x", "y", "label", "group")
    if background:
        scored = raster.tissue_score(C)
        levels = raster.otsu_levels(scored)
        ceiling = F.greatest(F.col("glass"), half_up((F.col("glass") + F.col("weak")) / 2))
        glass = (
            scored.join(levels.select("slide", "glass", "weak"), "slide")
            .filter(F.col("score") <= ceiling)
            .select("slide", "x", "y")
            .join(taken.select("slide", "x", "y").distinct(), ["slide", "x", "y"], "left_anti")
        )
        n = glass.groupBy("slide").agg(F.count(F.lit(1)).alias("n"))
        base = groups.groupBy("slide").agg(F.count(F.lit(1)).alias("base"))
        step = F.greatest(F.lit(1), F.ceil(F.col("n") / background_samples))
        g = row_numbers(glass, "slide", F.col("y"), [F.col("y"), F.col("x")], "k").join(n, "slide")
        g = g.join(base, "slide", "left").filter(F.col("k") % step == 0)
        group = F.coalesce("base", F.lit(0)) + F.floor(F.col("k") / step) % BACKGROUND_REGIONS
        samples = samples.unionByName(g.select("slide", "x", "y", F.lit(0).alias("label"), group.cast("int").alias("group")))
    feats = raster.cell_features(C)
    out = samples.join(feats, ["slide", "x", "y"]).select(
        "slide", "x", "y", F.col("label").cast("int").alias("label"), F.col("group").cast("int").alias("group"),
        F.array(*[F.col(c) for c in raster.FEATURES]).alias("features"))
    skipped = R.select("slide", "id", "label").join(sizes.select("slide", "id"), ["slide", "id"], "left_anti")
    return out, skipped


def merge_samples(*parts: DataFrame) -> DataFrame:
    """Samples of many slides as one set, groups renumbered so no two slides share one.

    A later part replaces the earlier samples of its slides.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.join(p.select("slide").distinct(), "slide", "left_anti").unionByName(p)
    ids = every.select("slide", "group").distinct()
    return every.join(
        ids.withColumn("new_group", F.dense_rank().over(W.orderBy("slide", "group")) - 1), ["slide", "group"]
    ).drop("group").withColumnRenamed("new_group", "group")


def training_summary(samples: DataFrame) -> DataFrame:
    """Slides, regions of each class and cells in a training set."""
    region = F.struct("slide", "group")
    return samples.groupBy().agg(
        F.count_distinct("slide").alias("slides"),
        F.count_distinct(F.when(F.col("label") == 1, region)).alias("tissue"),
        F.count_distinct(F.when(F.col("label") == 0, region)).alias("artefact"),
        F.count(F.lit(1)).alias("cells"),
    )


def similar_regions(
    field: DataFrame, lattice: DataFrame, meta: DataFrame, threshold, min_patches: int = 4,
    tolerance: float = 0.75, tile: int = cc.TILE, source: str = "model", model_id: str = "similar",
) -> tuple[DataFrame, DataFrame]:
    """(regions, cells) where a field clears a threshold, on the patch lattice.

    ``threshold`` is a number or a table (slide, threshold).  A cell without a patch is
    never above it.  Size is the number of patches; holes stay in their region.
    """
    f = lattice.join(field.select("slide", "patch_id", "value"), ["slide", "patch_id"])
    cut = threshold if isinstance(threshold, DataFrame) else None
    f = f.join(cut, "slide").filter(F.col("value") > F.col("threshold")) if cut is not None else f.filter(F.col("value") > threshold)
    on = f.select("slide", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(1).alias("m"))
    cells = cc.label_components(on, tile)
    sizes = cells.groupBy("slide", "label").agg(F.count(F.lit(1)).alias("patches")).filter(F.col("patches") >= min_patches)
    kept = cells.join(sizes, ["slide", "label"])
    rings = contour.trace_regions(kept, ["slide", "label"], 0.0, tolerance)
    regions = (
        rings.join(sizes, ["slide", "label"]).join(meta, "slide")
        .select(
            "slide", F.concat_ws("-", F.lit(model_id), "slide", F.col("label").cast("string")).alias("id"),
            F.lit("Polygon").alias("geom_type"),
            F.array(contour.to_slide("rings", F.col("origin_x"), F.col("origin_y"), F.col("step"), F.col("step"), 0.5)).alias("polygons"),
            "patches", F.lit(source).alias("source"), F.lit(model_id).alias("model_id"), F.lit(False).alias("locked"),
        )
    )
    return regions, kept
