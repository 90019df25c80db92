"""GeoJSON annotations and signature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchframe.functions import geometry as geo
from patchframe.functions.scalar import file_stem, pack_rgb
from patchframe.operators.annotations import ensure_classes
from patchframe.schema import ROI_CLASS

# The name other viewers give a region of interest, and its colour.
ROI_NAME, ROI_RGB = "Region*", (76, 194, 196)
SUPPORTED = ("Polygon", "MultiPolygon", "Point", "LineString")

_EXTRA = (
    "id string, source string, modelId string, confidence double, roiId string, isRoi boolean, "
    "createdAt double, updatedAt double"
)


def _feature_schema(key: str) -> str:
    return (
        "type string, id string, geometry struct<type:string,coordinates:string>, "
        "properties struct<objectType:string,classification:struct<name:string,colorRGB:int>,isLocked:boolean,"
        f"name:string,measurements:string,`{key}`:struct<"
        + ",".join(f.strip().replace(" ", ":") for f in _EXTRA.split(","))
        + ">>"
    )


def _polygons(kind: Column, text: Column) -> Column:
    """Coordinates text of any supported geometry as polygons > rings > points."""
    point = lambda a: F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"))
    ring = lambda r: F.transform(r, point)
    parse = lambda t: F.from_json(text, F.lit(t))
    return (
        F.when(kind == "Polygon", F.array(F.transform(parse("array<array<array<double>>>"), ring)))
        .when(kind == "MultiPolygon", F.transform(parse("array<array<array<array<double>>>>"), lambda p: F.transform(p, ring)))
        .when(kind == "LineString", F.array(F.array(ring(parse("array<array<double>>")))))
        .when(kind == "Point", F.array(F.array(F.array(point(parse("array<double>"))))))
    )


def _measurements(text: Column) -> Column:
    """Either a list of {name, value} or an object, as a map.  Of equal names the last counts."""
    items = F.from_json(text, F.lit("array<struct<name:string,value:double>>"))

    def last(m, i):
        later = F.slice(items, i + 2, F.size(items))
        return m["name"].isNotNull() & ~F.exists(later, lambda o: o["name"] == m["name"])

    listed = F.map_from_entries(F.filter(items, last))
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(F.from_json(text, F.lit("map<string,double>")))


def read_geojson(
    spark: SparkSession, path, classes: DataFrame, extra_key: str = "patchframe",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, classes, skipped per file) from FeatureCollections, bare arrays,
    single Features, or one Feature per line.

    ``extra_key`` is the foreign member a tool keeps its own fields in.  Classes are
    matched by name and added when new.
    """
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    t = F.trim("value")
    lines = ~t.startswith("[") & t.rlike(r"\}\s*\n\s*\{")
    fs = _feature_schema(extra_key)
    many = F.from_json(t, F.lit(f"array<struct<{_nest(fs)}>>"))
    root = F.from_json(t, F.lit(f"type string, features array<struct<{_nest(fs)}>>"))
    one = F.array(F.from_json(t, F.lit(fs)))
    each = F.transform(F.filter(F.split(t, r"\n"), lambda l: F.trim(l) != ""), lambda l: F.from_json(l, F.lit(fs)))
    features = (
        F.when(t.startswith("["), many).when(lines, each)
        .when(root["features"].isNotNull(), root["features"]).when(root["type"] == "Feature", one)
    )
    f = docs.select("file", F.posexplode(features).alias("seq", "f"))
    kind = F.col("f.geometry.type")
    ok = F.coalesce(kind.isin(*SUPPORTED), F.lit(False))
    skipped = f.groupBy("file").agg(F.sum((~ok).cast("bigint")).alias("skipped"))
    # A document is named for its slide, or lies in the slide's folder as written here.
    folder = F.regexp_extract("file", "/slide=([^/]+)/", 1)
    slide = F.when(folder != "", F.url_decode(folder)).otherwise(file_stem("file"))
    x = F.col(f"f.properties.`{extra_key}`")
    cls = F.col("f.properties.classification.name")
    roi = F.coalesce(x["isRoi"], F.lit(False)) | F.coalesce(cls == ROI_NAME, F.lit(False))
    a = f.filter(ok).select(
        slide.alias("slide"), "file", "seq",
        F.coalesce(x["id"], F.col("f.id"), F.concat_ws("-", slide, F.col("seq").cast("string"))).alias("id"),
        kind.alias("geom_type"), _polygons(kind, F.col("f.geometry.coordinates")).alias("polygons"),
        roi.alias("__roi"), F.when(~roi, F.trim(cls)).alias("__class"),
        F.col("f.properties.classification.colorRGB").alias("__rgb"),
        F.when(F.col("f.properties.objectType") == "detection", "detection").otherwise("annotation").alias("object_type"),
        F.when(x["source"] == "model", "model").otherwise("human").alias("source"),
        x["modelId"].alias("model_id"), x["confidence"].alias("confidence"), x["roiId"].alias("roi_id"),
        F.coalesce(F.col("f.properties.isLocked"), F.lit(False)).alias("locked"),
        F.col("f.properties.name").alias("name"),
        _measurements(F.col("f.properties.measurements")).alias("measurements"),
        F.timestamp_millis(x["createdAt"].cast("bigint")).alias("created_at"),
        F.timestamp_millis(x["updatedAt"].cast("bigint")).alias("updated_at"),
    )
    names = a.filter(F.col("__class").isNotNull()).groupBy(F.col("__class").alias("name")).agg(
        F.min(F.struct("file", "seq")).alias("seq"), F.max("__rgb").alias("color"))
    every = ensure_classes(names.select("name", "seq"), classes)
    colour = names.groupBy(F.lower("name").alias("__k")).agg(F.max("color").alias("color"))
    every = every.join(colour, F.lower("name") == F.col("__k"), "left").drop("__k")
    by_name = every.groupBy(F.lower(F.trim("name")).alias("__k")).agg(F.min_by("class_id", "ordinal").alias("__id"))
    a = a.join(by_name, F.lower("__class") == F.col("__k"), "left").withColumn(
        "class_id", F.when(F.col("__roi"), F.lit(ROI_CLASS)).otherwise(F.col("__id")))
    return geo.with_bbox(a.drop("__roi", "__class", "__rgb", "__k", "__id", "file", "seq")), every, skipped


def _nest(ddl: str) -> str:
    """Top-level columns of a schema string as fields of a struct."""
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = word.strip().partition(" ")
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def _coordinates(kind: str = "geom_type", polygons: str = "polygons") -> Column:
    """Polygons back to coordinates text, at the depth the geometry kind needs."""
    p = F.col(polygons)
    xy = lambda q: F.array(q.x, q.y)
    ring = lambda r: F.transform(r, xy)
    poly = lambda g: F.transform(g, ring)
    return (
        F.when(F.col(kind) == "Polygon", F.to_json(poly(p[0])))
        .when(F.col(kind) == "MultiPolygon", F.to_json(F.transform(p, poly)))
        .when(F.col(kind) == "LineString", F.to_json(ring(p[0][0])))
        .otherwise(F.to_json(xy(p[0][0][0])))
    )


def geojson_features(R: DataFrame, classes: DataFrame, extra_key: str = "patchframe") -> DataFrame:
    """``slide, id, feature``: each annotation as GeoJSON text."""
    c = classes.select("class_id", F.col("name").alias("__cname"), (
        F.col("color") if "color" in classes.columns else F.lit(None)).cast("int").alias("__crgb"))
    d = R.join(c, "class_id", "left")
    opt = lambda n, kind: F.col(n) if n in R.columns else F.lit(None).cast(kind)
    is_roi = F.coalesce(F.col("class_id") == ROI_CLASS, F.lit(False))
    cls = F.when(is_roi, F.struct(F.lit(ROI_NAME).alias("name"), pack_rgb(*map(F.lit, ROI_RGB)).alias("colorRGB"))).when(
        F.col("__cname").isNotNull(), F.struct(F.col("__cname").alias("name"), F.col("__crgb").alias("colorRGB")))
    extra = F.struct(
        "id", F.col("source"), opt("model_id", "string").alias("modelId"), opt("confidence", "double").alias("confidence"),
        opt("roi_id", "string").alias("roiId"), F.when(is_roi, F.lit(True)).alias("isRoi"),
        F.unix_millis(opt("created_at", "timestamp")).alias("createdAt"),
        F.unix_millis(opt("updated_at", "timestamp")).alias("updatedAt"),
    )
    props = F.struct(
        F.coalesce(opt("object_type", "string"), F.lit("annotation")).alias("objectType"), cls.alias("classification"),
        F.coalesce(opt("locked", "boolean"), F.lit(False)).alias("isLocked"), opt("name", "string").alias("name"),
        opt("measurements", "map<string,double>").alias("measurements"), extra.alias(extra_key),
    )
    text = F.concat(
        F.lit('{"type":"Feature","id":'), F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7),
        F.lit(',"geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), _coordinates(), F.lit('},"properties":'),
        F.to_json(props), F.lit("}"),
    )
    return d.select("slide", "id", text.alias("feature"))


def geojson_documents(
    R: DataFrame, classes: DataFrame, max_features: int, extra_key: str = "patchframe",
) -> DataFrame:
    """``slide, part, value``: FeatureCollections, one per slide.

    A slide with more than ``max_features`` annotations is split over several whole
    documents by id, so that no task builds an unbounded one; the reader takes them all.
    """
    f = geojson_features(R, classes, extra_key)
    n = f.groupBy("slide").agg(F.ceil(F.count(F.lit(1)) / max_features).cast("bigint").alias("__n"))
    d = f.join(n, "slide").withColumn("part", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    body = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda s: s.feature))
    return d.groupBy("slide", "part").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("value"))


def write_geojson(R: DataFrame, classes: DataFrame, path: str, max_features: int | None = None, **options) -> None:
    """One folder per slide with one Feature a line, whatever their number.

    ``max_features`` asks for FeatureCollections of about that many instead, one a file.
    """
    if max_features is None:
        f = geojson_features(R, classes, **options)
        f.select("slide", F.col("feature").alias("value")).write.mode("overwrite").partitionBy("slide").text(path)
        return
    d = geojson_documents(R, classes, max_features, **options)
    d.select("slide", "part", "value").write.mode("overwrite").partitionBy("slide", "part").text(path)


def parse_signatures(docs: DataFrame) -> DataFrame:
    """Signatures from documents (``file, value``).

    Genes are {gene, weight} or bare symbols of weight 1; a weight that is no finite
    number counts as 1; unnamed and empty signatures are left out.
    """
    root = F.from_json("value", F.lit("source string, organism string, signatures array<struct<name:string,genes:array<string>,cells:double>>"))
    d = docs.select("file", root.alias("r")).select(
        "file", "r.source", "r.organism", F.posexplode("r.signatures").alias("seq", "s"))
    d = d.filter((F.trim("s.name") != "") & (F.size("s.genes") > 0)).select(
        "file", "source", "organism", "seq", F.trim("s.name").alias("name"), F.col("s.cells").cast("bigint").alias("cells"),
        F.posexplode("s.genes").alias("rank", "g"))
    rec = F.from_json("g", F.lit("gene string, weight double"))
    is_object = F.col("g").startswith("{")
    w = rec["weight"]
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    return d.select(
        "file", "source", "organism", "seq", "name", "cells", "rank",
        F.when(is_object, rec["gene"]).otherwise(F.col("g")).alias("gene"),
        F.when(is_object & finite, w).otherwise(1.0).alias("weight"),
    ).filter(F.col("gene").isNotNull() & (F.col("gene") != ""))


def read_signatures(spark: SparkSession, path) -> DataFrame:
    """``sig_idx, name, gene, weight, cells`` of a signature file; an error when none is usable."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    d = parse_signatures(docs)
    if d.isEmpty():
        raise ValueError("no usable signatures in that file")
    return d.select(F.col("seq").cast("int").alias("sig_idx"), "name", "gene", "weight", "cells")


__all__ = ["read_geojson", "geojson_features", "geojson_documents", "write_geojson", "parse_signatures", "read_signatures"]
