"""Patch grids, spatial joins, lattices and blended fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.functions import geometry as geo
from patchframe.functions import scalar
from patchframe.operators import grid, joins, lattice

from . import base as b
from .base import query, r
from .enrich import EDGES_SQL, INSIDE_SQL, RINGS, regions

# Customers and suppliers as points: slide = nation, coordinates from the key.
POINTS_SQL = """
points AS (
  SELECT 'n' || c_nationkey AS slide, c_custkey AS point_id, (c_custkey * 7919 % 2500)::DOUBLE AS px,
         (c_custkey * 104729 % 1000)::DOUBLE AS py
  FROM customer)"""


def points(spark, sf):
    k = F.col("c_custkey")
    return b.table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("slide"), k.alias("point_id"),
        (k * 7919 % 2500).cast("double").alias("px"), (k * 104729 % 1000).cast("double").alias("py"))


CLASSES = [(0, "crypt"), (1, "stroma"), (2, "vessel")]


@query("points_in_regions", f"""
WITH {b.patches_sql()}, {EDGES_SQL}, {INSIDE_SQL}
SELECT slide, patch_id, id FROM hits""")
def points_in_regions(spark, sf):
    E = b.expression(spark, sf)
    return joins.points_in_regions(E.select("slide", "patch_id", "x", "y", "side"), regions(E), "id").select(
        "slide", "patch_id", "id")


@query("filtered_patches", f"""
WITH {b.patches_sql()}, {EDGES_SQL}, {INSIDE_SQL}
SELECT slide, patch_id FROM hits WHERE id = 'b'
INTERSECT
SELECT slide, patch_id FROM hits WHERE slide <> 's1' OR id = 'a'""")
def filtered_patches(spark, sf):
    """Two filters that must both hold; the second one is tighter on one slide."""
    E = b.expression(spark, sf)
    R = regions(E)
    second = R.filter((F.col("slide") != "s1") | (F.col("id") == "a"))
    P = E.select("slide", "patch_id", "x", "y", "side")
    return joins.filter_patches(P, R.filter("id = 'b'"), second).select("slide", "patch_id")


@query("label_patches", f"""
WITH {b.patches_sql()}, {EDGES_SQL}, {INSIDE_SQL}
SELECT slide, patch_id, min(CASE id WHEN 'b' THEN 0 ELSE 1 END)::INT AS label FROM hits GROUP BY ALL""")
def label_patches(spark, sf):
    E = b.expression(spark, sf)
    classes = spark.createDataFrame(CLASSES, "ordinal int, class_id string")
    return joins.label_patches(E, regions(E), classes)[0]


@query("label_counts", f"""
WITH {b.patches_sql()}, {EDGES_SQL}, {INSIDE_SQL},
l AS (SELECT slide, patch_id, min(CASE id WHEN 'b' THEN 0 ELSE 1 END) AS label FROM hits GROUP BY ALL)
SELECT ordinal::INT AS ordinal, class_id, count(label) AS n
FROM (VALUES (0, 'crypt'), (1, 'stroma'), (2, 'vessel')) c(ordinal, class_id)
LEFT JOIN l ON label = ordinal GROUP BY ALL""")
def label_counts(spark, sf):
    E = b.expression(spark, sf)
    classes = spark.createDataFrame(CLASSES, "ordinal int, class_id string")
    return joins.label_patches(E, regions(E), classes)[1]


def annotations(spark, sf):
    """Orders' suppliers as annotations: a square around every supplier, and every
    third one also a point; slide = nation."""
    k = F.col("s_suppkey")
    x, y = (k * 6151 % 2500).cast("double"), (k * 3571 % 1000).cast("double")
    side = (k % 5 * 60 + 90).cast("double")
    s = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("slide"), k.alias("k"),
        x.alias("x"), y.alias("y"), side.alias("side"), (k % 4 == 0).alias("locked"),
        F.element_at(F.array(*[F.lit(c) for c in ("crypt", "stroma", "__roi__", None)]), (k % 4 + 1).cast("int")).alias("class_id"),
        F.when(k % 3 == 0, "model").otherwise("human").alias("source"))
    squares = s.select(
        "slide", F.concat(F.lit("q"), F.col("k").cast("string")).alias("id"), F.lit("Polygon").alias("geom_type"),
        geo.square_polygons("x", "y", "side").alias("polygons"), "locked", "class_id", "source")
    dots = s.filter(F.col("k") % 3 == 0).select(
        "slide", F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.array(F.struct("x", "y")))).alias("polygons"), "locked", "class_id", "source")
    return squares.unionByName(dots)


ANNOTATIONS_SQL = """
sup AS (
  SELECT 'n' || s_nationkey AS slide, s_suppkey AS k, (s_suppkey * 6151 % 2500)::DOUBLE AS x,
         (s_suppkey * 3571 % 1000)::DOUBLE AS y, (s_suppkey % 5 * 60 + 90)::DOUBLE AS side,
         s_suppkey % 4 = 0 AS locked,
         CASE s_suppkey % 4 WHEN 0 THEN 'crypt' WHEN 1 THEN 'stroma' WHEN 2 THEN '__roi__' END AS class_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'model' ELSE 'human' END AS source
  FROM supplier),
squares AS (SELECT *, 'q' || k AS id FROM sup),
dots AS (SELECT *, 'p' || k AS id FROM sup WHERE k % 3 = 0)"""


@query("hit_test", f"""
WITH {POINTS_SQL}, {ANNOTATIONS_SQL},
h AS (
  SELECT p.slide, point_id, id, 0 AS kind, 0.0 AS area FROM points p JOIN dots d ON p.slide = d.slide
   AND sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 25
  UNION ALL
  SELECT p.slide, point_id, id, 1, side * side FROM points p JOIN squares s ON p.slide = s.slide
   AND px >= x AND px < x + side AND py >= y AND py < y + side)
SELECT slide, point_id, arg_min(id, (kind, area, id)) AS id FROM h GROUP BY slide, point_id""")
def hit_test(spark, sf):
    return joins.hit_test(points(spark, sf), annotations(spark, sf), 25.0)


@query("box_query", f"""
WITH {ANNOTATIONS_SQL}, a AS (SELECT slide, id, locked, x, y, x + side AS x1, y + side AS y1 FROM squares
  UNION ALL SELECT slide, id, locked, x, y, x, y FROM dots),
boxes AS (SELECT DISTINCT slide, box_id, bx0, by0, bx1, by1 FROM sup,
  (VALUES (1, 200.0, 100.0, 900.0, 500.0), (2, 1000.0, 0.0, 1400.0, 2000.0)) v(box_id, bx0, by0, bx1, by1))
SELECT a.slide, box_id, id FROM a JOIN boxes b ON a.slide = b.slide AND NOT locked
   AND x <= bx1 AND x1 >= bx0 AND y <= by1 AND y1 >= by0""")
def box_query(spark, sf):
    R = annotations(spark, sf)
    two = F.explode(F.array(
        F.struct(F.lit(1).alias("box_id"), F.lit(200.0).alias("bx0"), F.lit(100.0).alias("by0"), F.lit(900.0).alias("bx1"), F.lit(500.0).alias("by1")),
        F.struct(F.lit(2).alias("box_id"), F.lit(1000.0).alias("bx0"), F.lit(0.0).alias("by0"), F.lit(1400.0).alias("bx1"), F.lit(2000.0).alias("by1"))))
    boxes = R.select("slide").distinct().select("slide", two.alias("b")).select("slide", "b.*")
    return joins.query_box(R, boxes, unlocked_only=True, tile=512.0)


@query("nearest_region", f"""
WITH {POINTS_SQL}, {ANNOTATIONS_SQL},
d AS (SELECT p.slide, point_id, id,
        sqrt(power(greatest(0, x - px, px - x - side), 2) + power(greatest(0, y - py, py - y - side), 2)) AS outside,
        least(abs(px - x), abs(px - x - side), abs(py - y), abs(py - y - side)) AS within,
        px BETWEEN x AND x + side AND py BETWEEN y AND y + side AS inn
      FROM points p JOIN squares s ON p.slide = s.slide),
e AS (SELECT slide, point_id, id, CASE WHEN inn THEN within ELSE outside END AS distance FROM d)
SELECT slide, point_id, arg_min(id, (distance, id)) AS id, {r('min(distance)')} AS distance
FROM e WHERE distance <= 150 GROUP BY ALL""")
def nearest_region(spark, sf):
    R = annotations(spark, sf).filter("geom_type = 'Polygon'")
    return b.rounded(joins.nearest_region(points(spark, sf), R, 150.0), "distance")


@query("region_geometry", f"""
WITH {ANNOTATIONS_SQL}
SELECT slide, id, {r('side * side')} AS area, x AS minx, y AS miny, x + side AS maxx, y + side AS maxy, FALSE AS degenerate
FROM squares
UNION ALL SELECT slide, id, 0.0, x, y, x, y, FALSE FROM dots""")
def region_geometry(spark, sf):
    R = geo.with_bbox(annotations(spark, sf))
    return R.select("slide", "id", b.fixed(geo.area("polygons", "geom_type")).alias("area"),
                    "minx", "miny", "maxx", "maxy", geo.is_degenerate("polygons", "geom_type").alias("degenerate"))


def grid_regions(spark, sf):
    """A rectangle per supplier to lay a grid over, inside a slide of 2300 x 1100."""
    k = F.col("s_suppkey")
    return b.table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("slide"), k.alias("region_id"),
        (k * 6151 % 2500 + 0.4).alias("x"), (k * 3571 % 1000 + 0.5).alias("y"),
        (k % 7 * 150 + 20.3).alias("width"), (k % 5 * 130 + 60.9).alias("height"),
        F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(2300).alias("bw"), F.lit(1100).alias("bh"))


@query("patch_grid", """
WITH reg AS (
  SELECT 'n' || s_nationkey AS slide, s_suppkey AS region_id,
         floor(s_suppkey * 6151 % 2500 + 0.4::DOUBLE + 0.5)::BIGINT AS ox, floor(s_suppkey * 3571 % 1000 + 0.5::DOUBLE + 0.5)::BIGINT AS oy,
         s_suppkey % 7 * 150 + 20.3::DOUBLE AS width, s_suppkey % 5 * 130 + 60.9::DOUBLE AS height
  FROM supplier),
dims AS (SELECT *, greatest(0, floor((width - 60) / 30) + 1)::BIGINT AS cols,
                greatest(0, floor((height - 60) / 30) + 1)::BIGINT AS rows_ FROM reg),
p AS (SELECT slide, region_id, c.col::INT AS col, w.row_::INT AS "row", ox + c.col * 30 AS x, oy + w.row_ * 30 AS y
      FROM dims, LATERAL (SELECT unnest(range(cols)) AS col) c, LATERAL (SELECT unnest(range(rows_)) AS row_) w)
SELECT slide, region_id, col, "row", x, y, 60 AS side, 15.0::DOUBLE AS patch_um,
       row_number() OVER (PARTITION BY slide, region_id ORDER BY "row", col) - 1 AS index
FROM p WHERE x >= 0 AND y >= 0 AND x + 60 <= 2300 AND y + 60 <= 1100""")
def patch_grid(spark, sf):
    g = grid.build_patch_grid(grid_regions(spark, sf), 30, 15, downsample=2.0, mpp=0.25, bounded=True)
    return b.rounded(g, "patch_um")


@query("pooled_grid", """
WITH reg AS (
  SELECT 'n' || s_nationkey AS slide, s_suppkey AS region_id,
         floor(s_suppkey * 6151 % 2500 + 0.9::DOUBLE)::BIGINT AS ox, floor(s_suppkey * 3571 % 1000 + 1.0::DOUBLE)::BIGINT AS oy,
         s_suppkey % 7 * 150 + 20.3::DOUBLE AS width, s_suppkey % 5 * 130 + 60.9::DOUBLE AS height
  FROM supplier),
dims AS (SELECT *, greatest(0, floor((width - 100) / 100) + 1)::BIGINT AS cols,
                greatest(0, floor((height - 100) / 100) + 1)::BIGINT AS rows_ FROM reg),
p AS (SELECT slide, region_id AS roi_id, c.col::INT AS col, w.row_::INT AS "row", ox + c.col * 100 AS x, oy + w.row_ * 100 AS y
      FROM dims, LATERAL (SELECT unnest(range(cols)) AS col) c, LATERAL (SELECT unnest(range(rows_)) AS row_) w)
SELECT slide, roi_id, x, y, row_number() OVER (PARTITION BY slide ORDER BY roi_id, "row", col) - 1 AS patch_id FROM p""")
def pooled_grid(spark, sf):
    g = grid.build_patch_grid(grid_regions(spark, sf), 100)
    even, odd = g.filter("region_id % 2 = 0"), g.filter("region_id % 2 = 1")
    return grid.pool_grids(even, odd).select("slide", "roi_id", "x", "y", "patch_id")


@query("patch_estimate", """
WITH reg AS (SELECT 'n' || s_nationkey AS slide, s_suppkey % 5 * 60 + 90.0::DOUBLE AS side FROM supplier)
SELECT slide, sum(power(greatest(0, floor((side - 40) / 20) + 1), 2))::BIGINT AS patches,
       (sum(power(greatest(0, floor((side - 40) / 20) + 1), 2)) * 1.5)::DOUBLE AS estimated_ms
FROM reg GROUP BY slide""")
def patch_estimate(spark, sf):
    R = geo.with_bbox(annotations(spark, sf).filter("geom_type = 'Polygon'"))
    return grid.estimate_patches(R, 40, 0.5, 1.0, ms_per_patch=1.5)


@query("pyramid_levels", """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 0.2 + s_suppkey % 4 * 0.1 END::DOUBLE AS mpp FROM supplier),
l AS (SELECT k, mpp, level, ds FROM s, (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 4.0), (3, 16.0)) v(level, ds))
SELECT 'k' || k AS slide, CASE WHEN max(mpp) IS NULL THEN 0
         ELSE arg_min(level, (round(abs(ds * mpp - 0.5), 9), level)) END::INT AS nearest,
       coalesce(max(CASE WHEN ds * mpp <= 0.5 * 1.01 THEN level END), 0)::INT AS coarsest
FROM l GROUP BY k""")
def pyramid_levels(spark, sf):
    k = F.col("s_suppkey")
    level = lambda i, ds: F.struct(F.lit(i).alias("level"), F.lit(0).cast("bigint").alias("width"),
                                   F.lit(0).cast("bigint").alias("height"), F.lit(ds).alias("downsample"))
    s = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("k"), k.cast("string")).alias("slide"),
        F.when(k % 9 != 0, F.lit(0.2) + k % 4 * F.lit(0.1)).alias("mpp"),
        F.array(level(0, 1.0), level(1, 2.0), level(2, 4.0), level(3, 16.0)).alias("levels"))
    near = grid.pick_level(s, 0.5).withColumnRenamed("level", "nearest")
    return near.join(grid.pick_level(s, 0.5, "coarsest").withColumnRenamed("level", "coarsest"), "slide")


@query("tissue_fraction", f"""
WITH {b.CELLS_SQL},
m AS (SELECT slide, x, y, CASE WHEN r < 220 THEN 1 ELSE 0 END AS m FROM cells),
p AS (SELECT DISTINCT slide, c.i * 90 AS x, w.i * 90 AS y, w.i * 70 + c.i AS patch_id
      FROM (SELECT DISTINCT slide FROM m), range(70) c(i), range(70) w(i)),
w AS (SELECT *, floor(x / 6400.0 * 64)::INT AS x0, floor(y / 6400.0 * 64)::INT AS y0 FROM p),
v AS (SELECT *, least(64, greatest(x0 + 1, floor((x + 200) / 6400.0 * 64)))::INT AS x1,
             least(64, greatest(y0 + 1, floor((y + 200) / 6400.0 * 64)))::INT AS y1 FROM w)
SELECT v.slide, patch_id, {r('sum(coalesce(m, 0)) / ((any_value(x1) - any_value(x0)) * (any_value(y1) - any_value(y0)))')} AS tissue_fraction
FROM v JOIN m ON v.slide = m.slide AND m.x >= x0 AND m.x < x1 AND m.y >= y0 AND m.y < y1
GROUP BY v.slide, patch_id
HAVING sum(m) / ((any_value(x1) - any_value(x0)) * (any_value(y1) - any_value(y0))) >= 0.25""")
def tissue_fraction(spark, sf):
    C = b.cells(spark, sf)
    s = C.select("slide").distinct()
    M = C.select("slide", "x", "y", (F.col("r") < 220).cast("int").alias("m"))
    P = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(69)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(69)))).select(
        "slide", (F.col("row").cast("bigint") * 70 + F.col("col")).alias("patch_id"),
        (F.col("col") * 90).alias("x"), (F.col("row") * 90).alias("y"), F.lit(200).alias("side"))
    ext = s.select("slide", F.lit(6400).alias("width"), F.lit(6400).alias("height"), F.lit(64).alias("tw"), F.lit(64).alias("th"))
    return b.rounded(grid.tissue_patches(P, M, ext).select("slide", "patch_id", "tissue_fraction"), "tissue_fraction")


@query("lattice", f"""
WITH {b.patches_sql(50)}
SELECT slide, (x // 50)::INT AS cx, (y // 50)::INT AS cy, patch_id FROM patches""")
def lattice_query(spark, sf):
    return lattice.lattice_of(b.expression(spark, sf, 50).select("slide", "patch_id", "x", "y", "side"))


_TAPER = """(0.02::DOUBLE + 0.98 * (0.5 * (1 + cos(pi() * least(1.0, abs(({c} + 0.5) * 50 - x - 50) / 50.0)))
            * 0.5 * (1 + cos(pi() * least(1.0, abs(({w} + 0.5) * 50 - y - 50) / 50.0)))))"""


@query("blend_field", f"""
WITH {b.patches_sql(50)},
c AS (SELECT slide, embedding[5]::DOUBLE AS value, (label < 6)::INT AS m, (x // 50 + dc.i)::INT AS col,
             (y // 50 + dr.i)::INT AS "row", {_TAPER.format(c='(x // 50 + dc.i)', w='(y // 50 + dr.i)')} AS w
      FROM patches, range(2) dc(i), range(2) dr(i)),
a AS (SELECT slide, col, "row", sum(w * value) / sum(w) AS value, sum(w * m) / sum(w) AS coverage FROM c GROUP BY ALL)
SELECT slide, col, "row", {r('value')} AS value, {r('coverage')} AS coverage FROM a WHERE coverage >= 0.5""")
def blend_field(spark, sf):
    E = b.expression(spark, sf, 50)
    f = E.select("slide", "patch_id", F.col("values")[4].cast("double").alias("value"))
    m = E.select("slide", "patch_id", (F.col("label") < 6).alias("in_tissue"))
    return b.rounded(lattice.blend_field(E, f, m, cell=50.0), "value", "coverage")


@query("blend_classes", f"""
WITH {b.patches_sql(50)},
c AS (SELECT slide, k.class, CASE k.class WHEN 0 THEN (embedding[1]::DOUBLE + 1) / 2 ELSE 1 - (embedding[1]::DOUBLE + 1) / 2 END AS prob,
             (x // 50 + dc.i)::INT AS col, (y // 50 + dr.i)::INT AS "row",
             {_TAPER.format(c='(x // 50 + dc.i)', w='(y // 50 + dr.i)')} AS w
      FROM patches, range(2) dc(i), range(2) dr(i), (VALUES (0), (1)) k(class))
SELECT slide, col, "row", class::INT AS class, {r('sum(w * prob) / sum(w)')} AS prob FROM c GROUP BY slide, col, "row", class""")
def blend_classes(spark, sf):
    E = b.expression(spark, sf, 50)
    p = (F.col("values")[0].cast("double") + 1) / 2
    probs = E.select("slide", "patch_id", F.posexplode(F.array(p, 1 - p)).alias("class", "prob"))
    return b.rounded(lattice.blend(E, probs, 50.0), "prob")


@query("scalar_functions", f"""
SELECT o_orderkey, {r(b.sf_sql('o_totalprice / 150000'))} AS sf, floor(o_totalprice / 1000 + 0.5)::BIGINT AS half_up,
       (255::BIGINT * 16777216 + (o_orderkey % 256) * 65536 + (o_orderkey * 7 % 256) * 256 + o_orderkey * 13 % 256 - 4294967296)::INT AS rgb,
       (o_orderkey * 7 % 256)::INT AS green,
       {r('1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0, o_totalprice / 10000 - 20))))')} AS sigmoid,
       o_orderkey // 64 || ',' || o_orderkey % 64 AS block
FROM orders""")
def scalar_functions(spark, sf):
    k = F.col("o_orderkey")
    rgb = scalar.pack_rgb(k % 256, k * 7 % 256, k * 13 % 256)
    return b.table(spark, sf, "orders").select(
        "o_orderkey", b.fixed(scalar.normal_sf(F.col("o_totalprice") / 150000)).alias("sf"),
        scalar.half_up(F.col("o_totalprice") / 1000).cast("bigint").alias("half_up"),
        rgb.alias("rgb"), scalar.unpack_rgb(rgb)["g"].alias("green"),
        b.fixed(scalar.sigmoid(F.col("o_totalprice") / 10000 - 20)).alias("sigmoid"),
        scalar.block_of(k, (k % 64) * 64, 64).alias("block"))
