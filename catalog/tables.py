"""Sources, sinks and key joins on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.functions.scalar import obs_name, patch_key
from patchframe.operators import joins, tissue
from patchframe.sources import documents, exports, listing

from . import base as b
from .base import query, r
from .fields import ANNOTATIONS_SQL, annotations

# Pages as a file listing: seven folders, five kinds of file per stem.
FILES_SQL = """
files AS (
  SELECT 'd' || page_id % 7 || '/s' || page_id // 5 || e AS path, length(html)::BIGINT AS length FROM pages,
  (SELECT unnest(['.svs', '.geojson', '.json', '.expression.bin', '.onnx.json']) AS e, unnest(range(5)) AS i) v
  WHERE page_id % 5 = i
  UNION ALL SELECT 'd' || page_id // 5 % 7 || '/m' || page_id || '.mrxs', 1 FROM pages WHERE page_id % 10 = 0
  UNION ALL SELECT 'd' || page_id // 5 % 7 || '/m' || page_id || '/Data.dat', 10 FROM pages WHERE page_id % 20 = 0
  UNION ALL SELECT 'd' || page_id // 5 % 7 || '/v' || page_id || '.vms', 2 FROM pages WHERE page_id % 10 = 3
  UNION ALL SELECT 'd' || page_id // 5 % 7 || '/v' || page_id || '_opt.jpg', 3 FROM pages WHERE page_id % 10 = 3)"""


def files(spark, sf):
    p = b.table(spark, sf, "pages")
    k = F.col("page_id")
    s = lambda c: c.cast("string")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".svs", ".geojson", ".json", ".expression.bin", ".onnx.json")]), (k % 5 + 1).cast("int"))
    own = p.select(F.concat(F.lit("d"), s(k % 7), F.lit("/s"), s(F.floor(k / 5)), ext).alias("path"), F.length("html").cast("bigint").alias("length"))
    folder = F.concat(F.lit("d"), s(F.floor(k / 5) % 7))
    more = lambda cond, name, n: p.filter(cond).select(F.concat(folder, F.lit("/"), name).alias("path"), F.lit(n).cast("bigint").alias("length"))
    out = own
    for part in (
        more(k % 10 == 0, F.concat(F.lit("m"), s(k), F.lit(".mrxs")), 1), more(k % 20 == 0, F.concat(F.lit("m"), s(k), F.lit("/Data.dat")), 10),
        more(k % 10 == 3, F.concat(F.lit("v"), s(k), F.lit(".vms")), 2), more(k % 10 == 3, F.concat(F.lit("v"), s(k), F.lit("_opt.jpg")), 3),
    ):
        out = out.unionByName(part)
    return out


@query("resolve_slides", f"""
WITH {FILES_SQL},
e AS (SELECT path, length, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^.]*)$', 1) AS ext,
             regexp_replace(path, '\\.[^.]*$', '') AS base FROM files WHERE path LIKE '%.svs' OR path LIKE '%.mrxs' OR path LIKE '%.vms'),
m AS (SELECT e.path AS entry_path, f.length FROM e JOIN files f ON f.path = e.path
      OR (ext = 'mrxs' AND starts_with(f.path, base || '/')) OR (ext = 'vms' AND f.path <> e.path AND starts_with(f.path, base)))
SELECT name, e.path AS entry_path, count(*) AS n_files, sum(m.length)::BIGINT AS bytes,
       CASE WHEN ext = 'mrxs' AND count(*) = 1 THEN 'missing: folder ' || regexp_extract(base, '([^/]*)$', 1)
            WHEN ext = 'mrxs' THEN 'missing: Slidedat.ini in ' || regexp_extract(base, '([^/]*)$', 1)
            WHEN ext = 'vms' AND count(*) = 1 THEN 'only this file listed' END AS warning
FROM e JOIN m ON m.entry_path = e.path GROUP BY name, e.path, ext, base""")
def resolve_slides(spark, sf):
    return listing.resolve_slides(files(spark, sf))[0].select("name", "entry_path", "n_files", "bytes", "warning")


@query("sidecar_pairing", f"""
WITH {FILES_SQL}, e AS (SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS base FROM files
  WHERE path LIKE '%.svs' OR path LIKE '%.mrxs' OR path LIKE '%.vms')
SELECT e.path AS entry_path, coalesce(g.path, j.path) AS annotations, coalesce(x.path, y.path) AS expression
FROM e LEFT JOIN files g ON g.path = base || '.geojson' LEFT JOIN files j ON j.path = base || '.json'
LEFT JOIN files x ON x.path = base || '.expression.bin' LEFT JOIN files y ON y.path = base || '.expr'""")
def sidecar_pairing(spark, sf):
    f = files(spark, sf)
    return listing.pair_sidecars(listing.resolve_slides(f)[0], f).select("entry_path", "annotations", "expression")


@query("match_maps", """
SELECT 'NATION' || n_nationkey || '.expression' AS map_slide, n_nationkey < 20 AS matched FROM nation""")
def match_maps(spark, sf):
    n = b.table(spark, sf, "nation")
    name = lambda prefix, suffix: F.concat(F.lit(prefix), F.col("n_nationkey").cast("string"), F.lit(suffix))
    maps = n.select(name("NATION", ".expression").alias("map_slide"))
    slides = n.filter("n_nationkey < 20").select(name("nation", ".svs").alias("name"))
    ok, refused = joins.match_maps(maps, slides)
    return ok.select("map_slide", F.lit(True).alias("matched")).unionByName(refused.select("map_slide", F.lit(False).alias("matched")))


@query("missing_embeddings", f"""
WITH {b.patches_sql()}
SELECT slide || '|enc|L1|100|' || x || ',' || y AS patch_key FROM patches WHERE label <> 3""")
def missing_embeddings(spark, sf):
    P = b.expression(spark, sf)
    P = P.withColumn("patch_key", patch_key(F.col("slide"), F.lit("enc"), F.lit(1), F.lit(100), F.col("x"), F.col("y")))
    return joins.missing_keys(P, P.filter("label = 3")).select("patch_key")


@query("gene_vocabulary", f"""
WITH {b.patches_sql()}, s AS (SELECT DISTINCT slide FROM patches), w AS (SELECT slide, 'g' || i * 9 AS gene, i FROM s, range(12) t(i))
SELECT slide, gene, i * 9 < 64 AS found FROM w""")
def gene_vocabulary(spark, sf):
    E = b.expression(spark, sf)
    w = E.select("slide").distinct().select("slide", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select(
        "slide", F.concat(F.lit("g"), (F.col("i") * 9).cast("string")).alias("gene"))
    found, missing = joins.gene_vocabulary(w, b.genes(E))
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("batch_report", f"""
WITH {b.CELLS_SQL}, s AS (SELECT DISTINCT slide FROM cells)
SELECT 'c' || i AS slide, CASE WHEN i = 1 THEN 'error' WHEN 'c' || i IN (SELECT slide FROM s) THEN 'written' ELSE 'missing' END AS status
FROM range((SELECT count(*) FROM s) + 2) t(i)""")
def batch_report(spark, sf):
    C = b.cells(spark, sf)
    rep = C.groupBy("slide").agg(F.count(F.lit(1)).alias("regions"))
    n = rep.count()
    listed = spark.range(n + 2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("slide"))
    bad = spark.createDataFrame([("c1", "unreadable")], "slide string, error string")
    return tissue.batch_report(listed, rep, bad).select("slide", "status")


@query("anndata_obs", f"""
WITH {b.patches_sql()}
SELECT slide, x || '_' || y AS obs, x + 50.0::DOUBLE AS cx, y + 50.0::DOUBLE AS cy, (label < 5)::INT AS in_tissue,
       {r('embedding[31]::DOUBLE')} AS first_gene, {r('embedding[3]::DOUBLE')} AS second_gene
FROM patches""")
def anndata_obs(spark, sf):
    """The exported tables joined again: observation names, centres, mask, gene order."""
    E = b.expression(spark, sf)
    want = spark.createDataFrame([("g30", 0), ("g2", 1)], "gene string, ordinal int")
    mask = E.select("slide", "patch_id", (F.col("label") < 5).alias("in_tissue"))
    t = exports.anndata_tables(E, b.genes(E), mask, want)
    d = t["obs"].join(t["X"].drop("obs"), ["slide", "patch_id"]).join(t["obsm_spatial"].drop("obs"), ["slide", "patch_id"])
    return d.select("slide", "obs", F.col("spatial")[0].alias("cx"), F.col("spatial")[1].alias("cy"), "in_tissue",
                    b.fixed(F.col("x_row")[0].cast("double")).alias("first_gene"), b.fixed(F.col("x_row")[1].cast("double")).alias("second_gene"))


@query("expression_csv", f"""
WITH {b.patches_sql()}
SELECT slide, patch_id, x, y, side, printf('%.5f', embedding[1]::DOUBLE) AS g0, printf('%.5f', embedding[64]::DOUBLE) AS g63 FROM patches""")
def expression_csv(spark, sf):
    return exports.expression_panel(b.expression(spark, sf), {"g0": 0, "g63": 63})


@query("expression_lines", f"""
WITH {b.patches_sql()}
SELECT slide, patch_id, patch_id || ',' || x || ',' || y || ',' || side || ',' ||
       array_to_string(list_transform(embedding, lambda v: printf('%.5f', v::DOUBLE)), ',') AS value FROM patches""")
def expression_lines(spark, sf):
    E = b.expression(spark, sf)
    return exports.expression_lines(E, b.genes(E))[1]


@query("geojson_round_trip", f"""
WITH {ANNOTATIONS_SQL}
SELECT slide, id, 'Polygon' AS geom_type, {r('side * side', 3)} AS area, x AS minx, y + side AS maxy FROM squares
UNION ALL SELECT slide, id, 'Point', 0.0, x, y FROM dots""")
def geojson_round_trip(spark, sf):
    """Annotations to GeoJSON text and back through the reader's parsing."""
    from patchframe.functions import geometry as geo

    R = annotations(spark, sf)
    classes = spark.createDataFrame([(0, "crypt", "Crypt"), (1, "stroma", "Stroma")], "ordinal int, class_id string, name string")
    f = documents.geojson_features(R, classes).select("slide", F.from_json(
        "feature", F.lit("id string, geometry struct<type:string,coordinates:string>")).alias("f"))
    d = f.select("slide", "f.id", F.col("f.geometry.type").alias("geom_type"),
                 documents._polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"))
    d = geo.with_bbox(d)
    return d.select("slide", "id", "geom_type", b.fixed(geo.area("polygons", "geom_type"), 3).alias("area"), "minx", "maxy")
