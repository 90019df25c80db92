"""What changes along an axis: Spearman correlation with the position in a corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions.scalar import fisher_z_p, value_bucket

from . import stats
from .expression import as_arrays, is_coded, with_rows
from .joins import patches_along
from .signatures import require_scored, score_signatures

T_BUCKETS = 4096
AXIS = ["slide", "axis_id"]


def axis_length(axes: DataFrame, slides: DataFrame | None = None) -> DataFrame:
    """Length in pixels and, where the slide's scale is known, in micrometres."""
    px = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    a = axes.withColumn("length_px", px)
    if slides is None:
        return a.withColumn("length_um", F.lit(None).cast("double"))
    return a.join(slides.select("slide", "mpp"), "slide", "left").withColumn(
        "length_um", F.col("length_px") * F.col("mpp")
    ).drop("mpp")


def corridor_positions(along: DataFrame) -> DataFrame:
    """Per corridor patch: mid-rank of ``t``, and whether it is in the first or last third.

    Positions are bucketed by ``t``, so a long corridor is ordered piece by piece.
    Ties in ``t`` go to the lower patch id in both thirds.
    """
    slim = along.select(*AXIS, "patch_id", "t")
    bucket = F.least(F.floor(F.col("t") * T_BUCKETS), F.lit(T_BUCKETS - 1)).cast("int")
    d = slim.withColumn("__b", bucket)
    sizes = d.groupBy(*AXIS, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    order = W.partitionBy(*AXIS).orderBy("__b")
    sizes = sizes.withColumn("__lo", F.sum("__bn").over(order) - F.col("__bn")).withColumn(
        "n", F.sum("__bn").over(W.partitionBy(*AXIS))
    )
    inner = W.partitionBy(*AXIS, "__b")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3 + 0.5))
    ahead = F.col("n") - F.col("__lo") - F.col("__bn")
    return (
        d.withColumn("__r", F.rank().over(inner.orderBy("t")))
        .withColumn("__ties", F.count(F.lit(1)).over(W.partitionBy(*AXIS, "__b", "t")))
        .withColumn("__up", F.row_number().over(inner.orderBy("t", "patch_id")))
        .withColumn("__down", F.row_number().over(inner.orderBy(F.desc("t"), "patch_id")))
        .join(sizes, [*AXIS, "__b"])
        .select(
            *AXIS, "patch_id", "t", "n",
            (F.col("__lo") + F.col("__r") + (F.col("__ties") - 1) / 2).alias("rt"),
            (F.col("__lo") + F.col("__up") <= third).alias("at_start"),
            (ahead + F.col("__down") <= third).alias("at_end"),
        )
    )


def rank_correlation(long: DataFrame, by: list[str]) -> DataFrame:
    """Spearman's rho of ``value`` against the ranks ``rt`` per group.

    Values are reduced to a histogram that carries the count and the sum of position
    ranks.  Every sum the correlation needs follows from mid-ranks of distinct
    values, first inside a value bucket and then shifted by the buckets below.
    Also returns n, the mean, and the means of the two ends.
    """
    v = F.col("value").cast("double") + F.lit(0.0)
    at = lambda c: F.col(c).cast("bigint")
    h = long.groupBy(*by, v.alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rt").alias("srt"),
        F.sum(F.col("rt") * F.col("rt")).alias("srt2"),
        F.sum(at("at_start")).alias("n0"), F.sum(at("at_end")).alias("n1"),
    ).withColumn("b", value_bucket("v"))
    inner = W.partitionBy(*by, "b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    h = h.withColumn("m", F.coalesce(F.sum("n").over(inner), F.lit(0)) + (F.col("n") + 1) / 2)
    n, m = F.col("n"), F.col("m")
    b = h.groupBy(*by, "b").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"),
        F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"), F.sum(m * F.col("srt")).alias("sx"),
        F.sum("srt").alias("srt"), F.sum("srt2").alias("srt2"),
        F.sum(n * F.col("v")).alias("sv"),
        F.sum("n0").alias("n0"), F.sum(F.col("n0") * F.col("v")).alias("sv0"),
        F.sum("n1").alias("n1"), F.sum(F.col("n1") * F.col("v")).alias("sv1"),
    )
    outer = W.partitionBy(*by).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("o", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    o = F.col("o")
    g = b.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("distinct").alias("distinct"),
        F.sum(F.col("s1") + o * n).alias("sr"),
        F.sum(F.col("s2") + o * 2 * F.col("s1") + o * o * n).alias("srr"),
        F.sum(F.col("sx") + o * F.col("srt")).alias("srx"),
        F.sum("srt").alias("st"), F.sum("srt2").alias("stt"), F.sum("sv").alias("sv"),
        F.sum("n0").alias("n0"), F.sum("sv0").alias("sv0"),
        F.sum("n1").alias("n1"), F.sum("sv1").alias("sv1"),
    )
    num = F.col("srx") - F.col("sr") * F.col("st") / n
    va = F.col("srr") - F.col("sr") * F.col("sr") / n
    vb = F.col("stt") - F.col("st") * F.col("st") / n
    varies = (F.col("distinct") > 1) & (vb > 0)
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), num / F.sqrt(F.when(varies, va * vb))))
    snapped = F.when(F.abs(rho) > 1 - 1e-12, F.signum(rho)).otherwise(rho)
    return g.select(
        *by, n, F.when(varies, snapped).otherwise(0.0).alias("rho"),
        (F.col("sv") / n).alias("mean"),
        (F.col("sv0") / F.when(F.col("n0") > 0, F.col("n0"))).alias("mean_start"),
        (F.col("sv1") / F.when(F.col("n1") > 0, F.col("n1"))).alias("mean_end"),
    )


def _gradient(long, key: list[str], axes, slides, min_patches, min_expression, on_small):
    by = [*AXIS, *key]
    g = rank_correlation(long, by)
    small = F.col("n") < min_patches
    if on_small == "drop":
        g = g.filter(~small)
    else:
        msg = F.format_string(
            f"axis %s on slide %s covers %d patches, at least {min_patches} are needed",
            F.col("axis_id").cast("string"), F.col("slide"), F.col("n"),
        )
        g = g.withColumn("n", F.when(small, F.raise_error(msg).cast("bigint")).otherwise(F.col("n")))
    g = g.withColumn("p", fisher_z_p("rho", "n"))
    if min_expression > 0:
        g = g.filter(F.col("mean") >= min_expression)
    g = stats.benjamini_hochberg(g, AXIS, tie=key[0])
    lengths = axis_length(axes, slides).select(*AXIS, "length_px", "length_um")
    return g.join(lengths, AXIS)


def gene_gradient(
    E: DataFrame, G: DataFrame, axes: DataFrame, width: float | None = None,
    slides: DataFrame | None = None, min_expression: float = 0.0, min_patches: int = 8,
    on_small: str = "error",
) -> DataFrame:
    """Per axis and gene: rho, p, q, mean, and the means of the first and last third.

    The corridor is cut and ranked on patch keys; the value arrays of its patches are
    fetched once, and only those are opened.
    """
    along = patches_along(E.select("slide", "patch_id", "x", "y", "side"), axes, width)
    pos = corridor_positions(along).select(*AXIS, "patch_id", "rt", "at_start", "at_end")
    wide = E.select("slide", "patch_id", "halves" if "halves" in E.columns else "values")
    long = (
        as_arrays(with_rows(wide, pos, ["slide", "patch_id"]))
        .select(*AXIS, "rt", "at_start", "at_end", F.posexplode("values").alias("gene_idx", "value"))
    )
    if is_coded(E):
        sz = G.select("slide", "gene_idx", "scale", "zero")
        long = long.join(sz, ["slide", "gene_idx"]).withColumn(
            "value", F.col("value") * F.col("scale").cast("double") + F.col("zero").cast("double")
        )
    g = _gradient(long, ["gene_idx"], axes, slides, min_patches, min_expression, on_small)
    return g.join(G.select("slide", "gene_idx", "gene"), ["slide", "gene_idx"])


def signature_gradient(
    E: DataFrame, G: DataFrame, axes: DataFrame, S: DataFrame, width: float | None = None,
    slides: DataFrame | None = None, score=score_signatures, min_patches: int = 8,
    on_small: str = "error",
) -> DataFrame:
    """The same for modules.  Scores are standardised over the whole slide first and
    cut to the corridor afterwards.  A slide with an axis and no module that can be scored
    raises, or is left out with ``on_small="drop"``."""
    along = patches_along(E.select("slide", "patch_id", "x", "y", "side"), axes, width)
    pos = corridor_positions(along)
    long = score(E, G, S).join(pos, ["slide", "patch_id"]).withColumnRenamed("score", "value")
    done = _gradient(long, ["sig_idx", "name"], axes, slides, min_patches, 0.0, on_small)
    return done if on_small == "drop" else require_scored(done, G, S, axes)


def ranked(df: DataFrame, key: str = "gene_idx") -> DataFrame:
    """Steepest first, in both directions."""
    return df.orderBy("slide", "axis_id", F.desc(F.abs("rho")), key)


