"""Which genes or modules separate a region from the rest of its slide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions.scalar import half_up

from . import stats
from .expression import code_histogram, is_coded
from .halves import mann_whitney_halves
from .signatures import require_scored, score_signatures


def region_sizes(E: DataFrame) -> DataFrame:
    """Patches inside and outside per slide: the numbers the size guard looks at."""
    i = F.col("inside").cast("bigint")
    return E.groupBy("slide").agg(F.sum(i).alias("n_in"), F.sum(1 - i).alias("n_out"))


def _guard(tested: DataFrame, min_patches: int, on_small: str) -> DataFrame:
    small = (F.col("n_in") < min_patches) | (F.col("n_out") < min_patches)
    if on_small == "drop":
        return tested.filter(~small)
    message = F.format_string(
        f"slide %s needs at least {min_patches} patches on each side: %d inside, %d outside",
        F.col("slide"), F.col("n_in"), F.col("n_out"),
    )
    return tested.withColumn(
        "n_in", F.when(small, F.raise_error(message).cast("bigint")).otherwise(F.col("n_in"))
    )


def _finish(tested: DataFrame, key: str) -> DataFrame:
    return stats.benjamini_hochberg(tested, "slide", tie=key)


def differential_expression(
    E: DataFrame, G: DataFrame, min_patches: int = 5, min_expression: float = 0.0,
    on_small: str = "error",
) -> DataFrame:
    """Per slide and gene: means in and out, difference, AUC, p, q.

    ``E`` carries a boolean ``inside``.  Byte-coded maps are tested on their codes
    and decoded after aggregation, half-precision maps (``halves``) on their bit
    patterns.  The expression floor comes before the
    correction.  Slides whose region is too small raise, or are left out with
    ``on_small="drop"``.
    """
    genes = G.select("slide", "gene_idx", "gene", "scale", "zero")
    by = ["slide", "gene_idx"]
    if "halves" in E.columns:
        u = mann_whitney_halves(E).join(genes, by)
    elif is_coded(E):
        h = code_histogram(E).withColumnRenamed("code", "v")
        u = stats.mann_whitney(h, by, bounded=True).join(genes, by)
        m, c = F.col("scale").cast("double"), F.col("zero").cast("double")
        u = u.withColumn("sum_in", F.col("sum_in") * m + c * F.col("n_in"))
        u = u.withColumn("sum_out", F.col("sum_out") * m + c * F.col("n_out"))
    else:
        long = E.select("slide", "inside", F.posexplode("values").alias("gene_idx", "value"))
        h = stats.group_histogram(long, by, "value", F.col("inside"))
        u = stats.mann_whitney(h, by).join(genes, by)
    tested = stats.compared(_guard(u, min_patches, on_small))
    if min_expression > 0:
        tested = tested.filter(F.col("mean") >= min_expression)
    return _finish(tested, "gene_idx").select(
        "slide", "gene_idx", "gene", "mean", "mean_in", "mean_out", "diff", "auc", "p", "q", "n_in", "n_out"
    )


def differential_signatures(
    E: DataFrame, G: DataFrame, S: DataFrame,
    score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = score_signatures,
    min_patches: int = 5, on_small: str = "error",
) -> DataFrame:
    """The same test over module scores.  A module a map cannot score has no rows and
    is left out rather than ranked at zero; a slide with no other raises, or is left out
    with ``on_small="drop"``."""
    scored = score(E, G, S)
    flags = E.select("slide", "patch_id", "inside")
    long = scored.join(flags, ["slide", "patch_id"])
    h = stats.group_histogram(long, ["slide", "sig_idx", "name"], "score", F.col("inside"))
    u = stats.mann_whitney(h, ["slide", "sig_idx", "name"])
    tested = stats.compared(_guard(u, min_patches, on_small))
    done = _finish(tested, "sig_idx").select(
        "slide", "sig_idx", F.col("name"), "mean_in", "mean_out", "diff", "auc", "p", "q", "n_in", "n_out"
    )
    return done if on_small == "drop" else require_scored(done, G, S, E)


def ranked(df: DataFrame, key: str = "gene_idx") -> DataFrame:
    """Most separable first within each slide."""
    return df.orderBy("slide", F.desc("auc"), key)


def _module(df: DataFrame, name: str, strength, weight, top: int, floor: float, tie: str) -> DataFrame:
    w = W.partitionBy("slide").orderBy(F.desc(strength), F.col(tie))
    return (
        df.filter(strength >= floor)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
        .select(
            "slide", F.lit(0).alias("sig_idx"), F.lit(name).alias("name"), "gene",
            (half_up(weight * 1e4) / 1e4).alias("weight"), "rank",
        )
    )


def module_from_enrichment(name: str, df: DataFrame, top: int = 40, min_separation: float = 0.15) -> DataFrame:
    """Signed module of the strongest separators, both directions, one per slide."""
    sep = F.col("auc") - 0.5
    return _module(df, name, F.abs(sep), sep * 2, top, min_separation, "gene_idx")


def module_from_gradient(name: str, df: DataFrame, top: int = 40, min_rho: float = 0.2) -> DataFrame:
    return _module(df, name, F.abs(F.col("rho")), F.col("rho"), top, min_rho, "gene_idx")
