"""Regions as documents: classes, edits, and area algebra on cell sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions import geometry as geo
from patchframe.functions.scalar import slug
from patchframe.schema import ROI_CLASS

from .components import TILE, label_components


# --- classes --------------------------------------------------------------------

def ensure_classes(names: DataFrame, classes: DataFrame) -> DataFrame:
    """The class list with every name in it (``ordinal, class_id, name``).

    Names match ignoring case.  A new class gets a slug of its name, with -2, -3 … when
    the slug is taken.  ``names`` has name and seq, the order of first use.
    """
    key = lambda c: F.lower(F.trim(c))
    have = classes.select(key(F.col("name")).alias("__k")).distinct()
    new = (
        names.withColumn("name", F.when(F.trim("name") == "", F.lit("Class")).otherwise(F.trim("name")))
        .withColumn("__k", key(F.col("name")))
        .join(have, "__k", "left_anti")
        .groupBy("__k").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
        .withColumn("__s", slug("name"))
    )
    base = F.regexp_replace("class_id", r"-\d+$", "")
    suffix = F.coalesce(F.expr(r"try_cast(regexp_extract(class_id, '-(\\d+)$', 1) AS int)"), F.lit(1))
    taken = classes.select(F.col("class_id").alias("__s"), F.lit(1).alias("__t")).unionByName(
        classes.filter(F.col("class_id") != base).select(base.alias("__s"), suffix.alias("__t"))
    ).filter(F.col("__t") >= 1).groupBy("__s").agg(
        F.collect_set("__t").alias("__taken"))
    # Free numbers of a slug in order: as many as there are new names and taken ones.
    numbered = new.withColumn("__n", F.row_number().over(W.partitionBy("__s").orderBy("seq")))
    free = F.filter(
        F.sequence(F.lit(1), F.col("__n") + F.size("__taken") + 1), lambda i: ~F.array_contains("__taken", i)
    )
    d = numbered.join(taken, "__s", "left").withColumn("__taken", F.coalesce("__taken", F.array().cast("array<int>")))
    d = d.withColumn("__i", F.element_at(free, F.col("__n")))
    cid = F.when(F.col("__i") == 1, F.col("__s")).otherwise(F.concat_ws("-", "__s", F.col("__i").cast("string")))
    # A numbered slug may equal another new name's plain slug: the later one is numbered again.
    d = d.withColumn("__cid", cid).withColumn("__again", F.row_number().over(W.partitionBy("__cid").orderBy("seq")))
    cid = F.when(F.col("__again") == 1, F.col("__cid")).otherwise(F.concat_ws("-", "__cid", F.col("__again").cast("string")))
    last = classes.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("__last"))
    fresh = d.join(last).select(
        (F.col("__last") + F.row_number().over(W.orderBy("seq"))).cast("int").alias("ordinal"),
        cid.alias("class_id"), "name",
    )
    return classes.select("ordinal", "class_id", "name").unionByName(fresh)


def is_tissue_detection() -> Column:
    return (F.col("source") == "model") & F.col("model_id").startswith("tissue-")


# --- replacing and marking ------------------------------------------------------

def replace_results(R: DataFrame, new: DataFrame, owner: Column) -> DataFrame:
    """Drop an owner's earlier unlocked results on the slides it ran on again, add the new."""
    again = new.select("slide").distinct().withColumn("__again", F.lit(True))
    old = R.join(again, "slide", "left").filter(
        ~(F.coalesce(owner, F.lit(False)) & ~F.coalesce("locked", F.lit(False)) & F.coalesce("__again", F.lit(False)))
    ).drop("__again")
    return old.unionByName(new, allowMissingColumns=True)


def mark_regions(R: DataFrame, ids: DataFrame, class_id: str) -> DataFrame:
    """A correction: the class, and human as the source, so a new run keeps it."""
    hit = ids.select("slide", "id", F.lit(True).alias("__hit")).distinct()
    d = R.join(hit, ["slide", "id"], "left")
    on = F.coalesce("__hit", F.lit(False)) & ~F.coalesce("locked", F.lit(False))
    return d.withColumns({
        "class_id": F.when(on, F.lit(class_id)).otherwise(F.col("class_id")),
        "source": F.when(on, F.lit("human")).otherwise(F.col("source")),
    }).select(*R.columns)


def annotation_summary(R: DataFrame) -> DataFrame:
    """Per slide and class: count, area, locked and by source; ``__roi__`` and null apart."""
    return R.withColumn("__a", geo.area("polygons", "geom_type")).groupBy(
        "slide", F.coalesce("class_id", F.lit("(none)")).alias("class_id")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__a").alias("area"),
        F.sum(F.coalesce("locked", F.lit(False)).cast("bigint")).alias("locked"),
        F.sum((F.col("source") == "model").cast("bigint")).alias("by_model"),
        F.sum((F.col("source") == "human").cast("bigint")).alias("by_human"),
    ).withColumn("is_roi", F.col("class_id") == ROI_CLASS)


def largest_first(R: DataFrame) -> DataFrame:
    return R.withColumn("area", geo.area("polygons", "geom_type")).orderBy("slide", F.desc("area"), "id")


# --- edit log -------------------------------------------------------------------

def replay_changes(log: DataFrame, upto: int | None = None) -> DataFrame:
    """State of a document from its edit log (slide, seq, op, id, before, after).

    The last entry of each id decides; removed ids are gone.
    """
    d = log if upto is None else log.filter(F.col("seq") <= upto)
    last = d.groupBy("slide", "id").agg(F.max_by(F.struct("op", "after"), "seq").alias("__l"))
    return last.filter(F.col("__l.op") != "removed").select("slide", "id", F.col("__l.after").alias("state"))


def inverse_changes(log: DataFrame, since: int, at: int) -> DataFrame:
    """Entries that undo everything after ``since``, to be appended from ``at`` on.

    Newest first, so the entry with the highest original number is undone first.
    """
    d = log.filter(F.col("seq") > since)
    top = d.agg(F.max("seq").alias("__top"))
    op = F.when(F.col("op") == "added", "removed").when(F.col("op") == "removed", "added").otherwise(F.col("op"))
    return d.join(top).select(
        "slide", (F.col("__top") - F.col("seq") + at).cast("bigint").alias("seq"), op.alias("op"), "id",
        F.col("after").alias("before"), F.col("before").alias("after"),
    )


def assign_class_log(R: DataFrame, ids: DataFrame, class_id: str | None, seq: int) -> DataFrame:
    """Log entries of a class assignment; rows that would not change give none."""
    to = F.lit(class_id).cast("string")
    return R.join(ids.select("slide", "id").distinct(), ["slide", "id"], "left_semi").filter(
        ~F.col("class_id").eqNullSafe(to)
    ).select("slide", F.lit(seq).cast("bigint").alias("seq"), F.lit("updated").alias("op"), "id",
             F.struct("class_id").alias("before"), F.struct(to.alias("class_id")).alias("after"))


def delete_class_log(R: DataFrame, class_id: str, seq: int) -> DataFrame:
    """Members of a deleted class become unclassified."""
    return R.filter(F.col("class_id") == class_id).select(
        "slide", F.lit(seq).cast("bigint").alias("seq"), F.lit("updated").alias("op"), "id",
        F.struct("class_id").alias("before"), F.struct(F.lit(None).cast("string").alias("class_id")).alias("after"))


# --- area algebra on cell sets --------------------------------------------------

CELL = ["slide", "cx", "cy"]


def cells_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).unionByName(b.select(*CELL)).distinct()


def cells_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*CELL), CELL, "left_anti")


def cells_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*CELL), CELL, "left_semi")


def dissolve_touching(R: DataFrame, new: DataFrame) -> DataFrame:
    """Merge a new region into what it touches of its class.

    ``R`` has slide, id, seq, class_id, locked and a cell per row; ``new`` slide,
    class_id and cells.  The earliest touched region keeps its id and takes all the
    cells; with nothing touched the cells come back under a null id.
    """
    stroke = new.select(*CELL, "class_id")
    touched = R.filter(~F.col("locked")).join(stroke, [*CELL, "class_id"], "left_semi").select(
        "slide", "class_id", "id", "seq").distinct()
    keep = touched.groupBy("slide", "class_id").agg(F.min_by("id", "seq").alias("keep"), F.min("seq").alias("kseq"))
    hit = touched.select("slide", "id", "class_id").join(keep, ["slide", "class_id"])
    old = R.join(hit.select("slide", "id", "keep", "kseq"), ["slide", "id"], "left")
    merged = old.select("slide", F.coalesce("keep", "id").alias("id"), F.coalesce("kseq", "seq").alias("seq"),
                        "class_id", "locked", "cx", "cy")
    added = stroke.join(keep, ["slide", "class_id"], "left").select(
        "slide", F.col("keep").alias("id"), F.col("kseq").alias("seq"), "class_id", F.lit(False).alias("locked"), "cx", "cy")
    return merged.unionByName(added).distinct()


def subtract_region(R: DataFrame, new: DataFrame) -> DataFrame:
    """Take a region's cells out of every unlocked region; emptied ones disappear."""
    gone = R.filter(~F.col("locked")).join(new.select(*CELL), CELL, "left_anti")
    return R.filter("locked").unionByName(gone)


def non_overlap(new: DataFrame, existing: DataFrame, area_factor: float = 8.0, keep: float = 0.1, tile: int = TILE) -> DataFrame:
    """Clip new objects by their neighbours, as cells do not overlap.

    Only unlocked neighbours of at most ``area_factor`` times an object's size count,
    regions of interest never.  The largest connected piece stays, and only if it is
    more than ``keep`` of the object.
    """
    own = new.groupBy("slide", "id").agg(F.count(F.lit(1)).alias("own"))
    size = existing.filter(~F.col("locked") & ~F.col("class_id").eqNullSafe(ROI_CLASS)).groupBy("slide", "id").agg(
        F.count(F.lit(1)).alias("other"))
    others = existing.join(size, ["slide", "id"]).select(*CELL, "other")
    d = new.join(own, ["slide", "id"])
    blocked = d.join(others, CELL).filter(F.col("other") <= F.col("own") * area_factor).select(*CELL, "id").distinct()
    left = d.join(blocked, [*CELL, "id"], "left_anti")
    # Each object is its own raster for the components.
    key = F.concat_ws("#", "slide", F.col("id").cast("string"))
    piece = label_components(left.select(key.alias("slide"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(1).alias("m")), tile)
    left = left.withColumn("__k", key).join(
        piece.select(F.col("slide").alias("__k"), F.col("x").alias("cx"), F.col("y").alias("cy"), "label"), ["__k", "cx", "cy"])
    sizes = left.groupBy("__k", "label", "own").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("__k").agg(F.max_by(F.struct("label", "n", "own"), F.struct("n", -F.col("label"))).alias("b")).filter(
        F.col("b.n") > F.col("b.own") * keep).select("__k", F.col("b.label").alias("label"))
    return left.join(best, ["__k", "label"], "left_semi").select("slide", "id", "cx", "cy")
