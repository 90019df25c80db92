"""Overview cells: scores, thresholds, morphology, texture features.

Masks are dense: one row per cell of the overview, background included.  Windows run
along a row or a column of cells, never over a slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions import scalar as sc


def read_cells(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("slide", "x", "y", "r", "g", "b")


def overview_step(slides: DataFrame, target_um: float) -> DataFrame:
    """Sampling step that brings each slide's cells (slide, cell_um) nearest to one size, the same for slides of any extent."""
    return slides.withColumn("step", F.greatest(F.lit(1), F.round(target_um / F.col("cell_um"))).cast("int"))


def downsample_cells(C: DataFrame, step: int | DataFrame) -> DataFrame:
    """Box average by a step, or by each slide's own step (slide, step).

    The whole level is read, never a crop.  Colours are truncated as a byte store would;
    a box cut off by the far edge averages what it holds.
    """
    boxes = C.withColumn("step", F.lit(int(step))) if isinstance(step, int) else C.join(step.select("slide", "step"), "slide")
    mean = lambda c: F.floor(F.avg(c)).cast("int").alias(c)
    part = lambda c: F.floor(F.col(c) / F.col("step")).cast("int").alias(c)
    return boxes.groupBy("slide", part("x"), part("y")).agg(mean("r"), mean("g"), mean("b"))


def fill_missing(C: DataFrame, extent: DataFrame) -> DataFrame:
    """Cells nothing covered become white.  ``extent`` has slide, w, h.

    The planner takes the exploded extent to be as small as ``extent``; the hint keeps it
    from being broadcast.
    """
    full = extent.select(
        "slide", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w"
    ).select("slide", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), "y")
    d = full.hint("merge").join(C, ["slide", "x", "y"], "left")
    return d.select("slide", "x", "y", *[F.coalesce(c, F.lit(255)).cast("int").alias(c) for c in "rgb"])


def tissue_score(C: DataFrame) -> DataFrame:
    """How far a cell is from blank glass: the stronger of saturation and darkness, 0..255."""
    s = F.greatest(sc.saturation("r", "g", "b"), sc.darkness("r", "g", "b"))
    return C.withColumn("score", sc.half_up(s).cast("int"))


def otsu_levels(scored: DataFrame, edge_bias: float = 0.22, weak_bias: float = 0.1) -> DataFrame:
    """Per slide: Otsu's split, glass level, and where tissue starts (relaxed) and fades (weak).

    Works on a histogram of at most 256 rows per slide.  Cuts that separate equally
    well form a run, and its middle is the split.  An overview of one score has no
    tissue: both levels become 256.
    """
    h = scored.groupBy("slide", F.col("score").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("slide").orderBy("t")
    whole = W.partitionBy("slide")
    c = (
        h.withColumn("wb", F.sum("n").over(upto).cast("double"))
        .withColumn("sb", F.sum(F.col("t") * F.col("n")).over(upto).cast("double"))
        .withColumn("total", F.sum("n").over(whole).cast("double"))
        .withColumn("sum", F.sum(F.col("t") * F.col("n")).over(whole).cast("double"))
        .withColumn("next_t", F.lead("t").over(upto))
    )
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / F.when(wf > 0, wf)
    c = c.withColumn("between", F.col("wb") * wf * gap * gap).withColumn("best", F.max("between").over(whole))
    # A cut at an occupied score holds up to the next occupied one: empty bins add nothing.
    tied = F.col("between") >= F.col("best") * (1 - 1e-9)
    first = F.min(F.when(tied, F.col("t"))).over(whole)
    last = F.max(F.when(tied, F.col("next_t") - 1)).over(whole)
    c = c.withColumn("auto", F.coalesce(sc.half_up((first + last) / 2), F.lit(0)).cast("int"))
    under = F.col("t") <= F.col("auto")
    mode = F.max(F.when(under, F.struct("n", (-F.col("t")).alias("t"))))
    d = c.groupBy("slide").agg(
        F.count(F.lit(1)).alias("occupied"), F.max("auto").alias("auto"), (-mode["t"]).alias("glass"))
    one = F.col("occupied") < 2
    span = F.greatest(F.lit(1), F.col("auto") - F.col("glass"))
    at = lambda bias: sc.half_up(F.col("glass") + span * bias).cast("int")
    return d.select(
        "slide", "auto",
        F.when(one, 0).otherwise(F.col("glass")).alias("glass"),
        F.when(one, 1).otherwise(span).alias("span"),
        F.when(one, 256).otherwise(F.greatest(F.lit(6), at(edge_bias))).alias("relaxed"),
        F.when(one, 256).otherwise(F.greatest(F.col("glass") + 2, at(weak_bias))).alias("weak"),
    )


def _sweep(c: str, r: int, axis: str, grow: bool) -> Column:
    across = {"x": ("y", "x"), "y": ("x", "y")}[axis]
    w = W.partitionBy("slide", across[0]).orderBy(across[1]).rangeBetween(-r, r)
    return (F.max if grow else F.min)(c).over(w)


def sweeps(M: DataFrame, columns: list[str], ops: list[tuple[str, int]]) -> DataFrame:
    """Apply dilations and erosions in turn, for several mask columns at once.

    The two directions of one square element commute, so successive steps share a
    direction: steps alternate their order and each pass along a direction does the
    second half of one step and the first half of the next.  A chain of n steps
    needs n + 1 exchanges instead of 2n.
    """
    axes = "yx"
    plan: list[tuple[str, list[tuple[int, bool]]]] = []
    for i, (kind, r) in enumerate(o for o in ops if o[1] > 0):
        first, second = (axes[0], axes[1]) if i % 2 == 0 else (axes[1], axes[0])
        step = (r, kind == "dilate")
        if plan and plan[-1][0] == first:
            plan[-1][1].append(step)
        else:
            plan.append((first, [step]))
        plan.append((second, [step]))
    for axis, steps in plan:
        for r, grow in steps:
            M = M.withColumns({c: _sweep(c, r, axis, grow) for c in columns})
    return M


def dilate(M, r, column="m"):
    return sweeps(M, [column], [("dilate", r)])


def erode(M, r, column="m"):
    return sweeps(M, [column], [("erode", r)])


def opening(M, r, column="m"):
    """Erode, then dilate: deletes what is thinner than the element."""
    return sweeps(M, [column], [("erode", r), ("dilate", r)])


def closing(M, r, column="m"):
    """Dilate, then erode: bridges gaps without moving the outline."""
    return sweeps(M, [column], [("dilate", r), ("erode", r)])


# Names and order of the cell features, and their version.
FEATURES = (
    "saturation", "darkness", "redGreen", "blueGreen", "detailFine", "detailCoarse",
    "saturationDetail", "localRange", "neighbourDarkness", "neighbourSaturation", "gradient", "chroma",
)
FEATURE_VERSION = 1


def cell_features(C: DataFrame, *keep: str) -> DataFrame:
    """Twelve colour and texture features per cell.

    Window sums are separable: one pass along rows for every radius, one along
    columns.  Windows are cut at the border and divided by the cells they hold.
    """
    lum, sat = sc.luminance("r", "g", "b"), sc.saturation("r", "g", "b")
    d = C.withColumns({"l": lum, "s": sat}).withColumns({"l2": F.col("l") * F.col("l"), "s2": F.col("s") * F.col("s")})
    wanted = [("l", 1), ("l2", 1), ("l", 2), ("l2", 2), ("l", 4), ("l2", 4), ("s", 4), ("s2", 4)]
    row, col = W.partitionBy("slide", "y").orderBy("x"), W.partitionBy("slide", "x").orderBy("y")
    one = F.lit(1)
    d = d.withColumns(
        {
            **{f"{c}_{r}": F.sum(c).over(row.rangeBetween(-r, r)) for c, r in wanted},
            **{f"n_{r}": F.count(one).over(row.rangeBetween(-r, r)) for r in (1, 2, 4)},
            "gx": F.coalesce(F.lead("l").over(row), F.col("l")) - F.coalesce(F.lag("l").over(row), F.col("l")),
        }
    ).withColumns(
        {
            **{f"{c}_{r}": F.sum(f"{c}_{r}").over(col.rangeBetween(-r, r)) for c, r in wanted},
            **{f"n_{r}": F.sum(f"n_{r}").over(col.rangeBetween(-r, r)) for r in (1, 2, 4)},
            "gy": F.coalesce(F.lead("l").over(col), F.col("l")) - F.coalesce(F.lag("l").over(col), F.col("l")),
        }
    )
    mean = lambda c, r: F.col(f"{c}_{r}") / F.col(f"n_{r}")
    std = lambda c, r: F.sqrt(F.greatest(F.lit(0.0), mean(f"{c}2", r) - mean(c, r) * mean(c, r)))
    values = [
        F.col("s"), 255 - F.col("l"), (F.col("r") - F.col("g")).cast("double"),
        (F.col("b") - F.col("g")).cast("double"), std("l", 1), std("l", 4), std("s", 4), std("l", 2) * 2,
        255 - mean("l", 4), mean("s", 4), F.hypot("gx", "gy"), sc.chroma("r", "g", "b").cast("double"),
    ]
    return d.select("slide", "x", "y", *keep, *[v.alias(n) for v, n in zip(values, FEATURES)])
