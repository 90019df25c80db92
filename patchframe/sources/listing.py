"""A flat file listing as slides, their companions and their sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchframe.functions.scalar import file_base, file_dir, file_ext, file_stem

# What makes a file a slide, and where the rest of its data lies.
ENTRY_EXTENSIONS = ("svs", "ndpi", "mrxs", "scn", "vms", "vmu", "tif", "tiff", "btf", "bif", "svslide", "dcm")
FOLDER_FORMATS = ("mrxs",)
PREFIX_FORMATS = ("vms", "vmu")
# Sidecar suffixes by preference; a tool with its own suffix puts it first.
ANNOTATION_SUFFIXES = (".geojson", ".json")
EXPRESSION_SUFFIXES = (".expression.bin", ".expr")
NOT_ANNOTATIONS = (".onnx.json",)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def resolve_slides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slides, members) of a listing (path, length).

    Slides have name, entry_path, n_files, bytes and a warning when their data is not
    there.  A DICOM folder is one slide.  Companions are found by equi joins on folder
    or on name prefix, never by comparing every file with every slide.
    """
    f = files.select("path", "length", file_dir("path").alias("dir"), file_ext("path").alias("ext"), file_stem("path").alias("stem"))
    entries = f.filter(F.col("ext").isin(*ENTRY_EXTENSIONS))
    plain = entries.filter("ext <> 'dcm'").select(F.col("path").alias("entry_path"), "dir", "ext", "stem", "length")

    # Folder formats: a file belongs to the slide whose folder is one of its ancestors.
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    in_folders = f.filter("dir <> ''").select("path", "length", F.explode(ancestors).alias("folder"))
    folder = plain.filter(F.col("ext").isin(*FOLDER_FORMATS)).select(
        "entry_path", _join_path(F.col("dir"), F.col("stem")).alias("folder"))
    by_folder = folder.join(in_folders, "folder").select("entry_path", "path", "length", "folder")

    # Prefix formats: a file meets the lengths of the prefixes in its folders, cut to those the prefixes.
    prefix = plain.filter(F.col("ext").isin(*PREFIX_FORMATS)).select(
        "entry_path", F.col("dir").alias("folder"), _join_path(F.col("dir"), F.col("stem")).alias("prefix"))
    lengths = prefix.select("folder", F.length("prefix").alias("k")).distinct()
    around = f.select("path", "length", F.explode(F.array_union(F.array(F.lit("")), ancestors)).alias("folder"))
    cut = around.join(lengths, "folder").filter(F.length("path") >= F.col("k"))
    by_prefix = cut.withColumn("prefix", F.expr("left(path, k)")).join(prefix, ["folder", "prefix"]).filter(
        F.col("path") != F.col("entry_path")).select("entry_path", "path", "length")

    own = plain.select("entry_path", F.col("entry_path").alias("path"), "length")
    dicom = entries.filter("ext = 'dcm'").select("path", "length", "dir")
    heads = dicom.groupBy("dir").agg(F.min("path").alias("entry_path"))
    dicom_members = dicom.join(heads, "dir").select("entry_path", "path", "length")
    members = own.unionByName(by_folder.drop("folder")).unionByName(by_prefix).unionByName(dicom_members)

    totals = members.groupBy("entry_path").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    ini = by_folder.filter(F.col("path") == F.concat_ws("/", "folder", F.lit("Slidedat.ini"))).select(
        "entry_path", F.lit(True).alias("__ini")).distinct()
    is_folder, is_prefix = F.col("ext").isin(*FOLDER_FORMATS), F.col("ext").isin(*PREFIX_FORMATS)
    alone = F.col("n_files") == 1
    warning = (
        F.when(is_folder & alone, F.concat(F.lit("missing: folder "), F.col("stem")))
        .when(is_folder & F.col("__ini").isNull(), F.concat(F.lit("missing: Slidedat.ini in "), F.col("stem")))
        .when(is_prefix & alone, F.lit("only this file listed"))
    )
    slides = plain.join(totals, "entry_path").join(ini, "entry_path", "left").select(
        file_base("entry_path").alias("name"), "entry_path", "dir", "stem", "n_files", "bytes", warning.alias("warning"))
    dcm = heads.join(totals, "entry_path").select(
        F.when(F.col("dir") == "", F.col("entry_path")).otherwise(file_base("dir")).alias("name"), "entry_path",
        "dir", F.lit(None).cast("string").alias("stem"), "n_files", "bytes", F.lit(None).cast("string").alias("warning"))
    return slides.unionByName(dcm), members


def pair_sidecars(
    slides: DataFrame, files: DataFrame, annotation_suffixes=ANNOTATION_SUFFIXES, expression_suffixes=EXPRESSION_SUFFIXES,
) -> DataFrame:
    """Add each slide's annotation and expression file: same folder, same stem, the
    preferred suffix that is there.  DICOM folders (no stem) have none."""
    both = [("annotations", i, s) for i, s in enumerate(annotation_suffixes)] + [
        ("expression", i, s) for i, s in enumerate(expression_suffixes)]
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("pref"), F.lit(s).alias("suffix")) for k, i, s in both]))
    base = _join_path(F.col("dir"), F.col("stem"))
    asked = slides.filter(F.col("stem").isNotNull()).select("entry_path", base.alias("b"), wanted.alias("w")).select(
        "entry_path", F.concat("b", "w.suffix").alias("path"), "w.kind", "w.pref")
    other = F.lit(False)
    for s in NOT_ANNOTATIONS:
        other = other | ((F.col("kind") == "annotations") & F.lower("path").endswith(s))
    found = asked.filter(~other).join(files.select("path"), "path").groupBy("entry_path").agg(
        *[F.min_by(F.when(F.col("kind") == k, F.col("path")), F.when(F.col("kind") == k, F.col("pref"))).alias(k)
          for k in ("annotations", "expression")])
    return slides.join(found, "entry_path", "left")


def map_names_slide(map_path: Column, slide_path: Column, suffixes=EXPRESSION_SUFFIXES) -> Column:
    """Is a map named for a slide: same base name without suffix, ignoring case."""
    base = F.lower(file_base(map_path))
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(base.endswith(s), F.substring(base, F.lit(1), F.length(base) - len(s))).otherwise(out)
    return F.coalesce(out == F.lower(file_stem(slide_path)), F.lit(False))
