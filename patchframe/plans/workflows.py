"""The questions people ask, as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchframe.operators import enrichment, lattice, learn, stats, tissue
from patchframe.operators.joins import flag_inside, label_patches
from patchframe.operators.signatures import score_signatures


def compare_region(E: DataFrame, G: DataFrame, regions: DataFrame, min_expression: float = 0.0,
                   on_small: str = "drop") -> DataFrame:
    """Which genes are enriched in the drawn regions, on every slide at once."""
    return enrichment.differential_expression(
        flag_inside(E, regions), G, min_expression=min_expression, on_small=on_small)


def find_similar(E: DataFrame, G: DataFrame, regions: DataFrame, percentile: float = 95.0, top: int = 40,
                 min_separation: float = 0.15, min_patches: int = 4) -> tuple[DataFrame, DataFrame]:
    """(regions, module): where else a slide looks like the example drawn on it.

    Enrichment of the example, its signed module, the module's score everywhere, and
    the outlines of the patches above a percentile of that score.
    """
    d = compare_region(E, G, regions)
    module = enrichment.module_from_enrichment("similar", d, top, min_separation)
    field = score_signatures(E, G, module).select("slide", "patch_id", F.col("score").alias("value"))
    P = E.select("slide", "patch_id", "x", "y", "side")
    cut = stats.percentile_threshold(field, percentile)
    found, _ = tissue.similar_regions(
        field, lattice.lattice_of(P), lattice.lattice_meta(P), cut, min_patches=min_patches)
    return found, module


def train_and_predict(P: DataFrame, embeddings: DataFrame, regions: DataFrame, classes: DataFrame, block_px: float,
                      stride: float | None = None, k: int | None = None) -> tuple[learn.LinearModel, DataFrame]:
    """Label by drawn regions, reduce, train, predict everywhere, blend overlaps."""
    comp = learn.pca_scores(embeddings.join(P, ["slide", "patch_id"]), k=k)
    every = comp.scores.select(*P.columns, F.col("scores").alias("features"))
    labels, _ = label_patches(P, regions, classes)
    half = F.col("side") / 2
    rows = every.join(labels, ["slide", "patch_id"]).withColumns(
        {"px": F.col("x") + half, "py": F.col("y") + half, "row": F.struct("slide", "patch_id")})
    names = [r["class_id"] for r in classes.orderBy("ordinal").collect()]
    model = learn.train_head(rows, names, block_px, population=every)
    return model, learn.predict_and_blend(model, every, stride=stride)


def segment_folder(C: DataFrame, slides: DataFrame, listed: DataFrame | None = None, done: DataFrame | None = None,
                   **options) -> tuple[DataFrame, DataFrame]:
    """(regions, report) of a folder of slides; slides already done are skipped."""
    if done is not None:
        todo = tissue.pending_slides(slides, done)
        C, slides = C.join(todo.select("slide"), "slide", "left_semi"), todo
    regions, _, report = tissue.detect_tissue(C, slides, **options)
    return regions, tissue.batch_report(listed if listed is not None else slides, report)
