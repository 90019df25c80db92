"""Overview cells: levels, morphology, features, components, tissue."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.operators import components as cc
from patchframe.operators import lattice, raster, stats, tissue

from . import base as b
from .base import query, r

SAT = "(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE * 255 END)"
LUM = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
SCORE_SQL = f"""{b.CELLS_SQL},
scored AS (SELECT *, floor(greatest({SAT}, 255 - {LUM}) + 0.5)::INT AS score FROM cells)"""

# All 256 bins, with the empty ones, as the definition has it.
LEVELS_SQL = f"""{SCORE_SQL},
bins AS (SELECT s.slide, t.i AS t, count(c.score) AS n FROM (SELECT DISTINCT slide FROM scored) s
         CROSS JOIN range(256) t(i) LEFT JOIN scored c ON c.slide = s.slide AND c.score = t.i GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w::DOUBLE AS wb, sum(t * n) OVER w::DOUBLE AS sb,
               sum(n) OVER (PARTITION BY slide)::DOUBLE AS tot, sum(t * n) OVER (PARTITION BY slide)::DOUBLE AS s
        FROM bins WINDOW w AS (PARTITION BY slide ORDER BY t)),
btw AS (SELECT *, wb * (tot - wb) * power(sb / wb - (s - sb) / (tot - wb), 2) AS bt FROM cum WHERE wb > 0 AND wb < tot),
best AS (SELECT slide, max(bt) AS m FROM btw GROUP BY slide),
autos AS (SELECT btw.slide, floor((min(t) + max(t)) / 2.0 + 0.5)::INT AS auto FROM btw JOIN best ON btw.slide = best.slide
          AND bt >= m * (1 - 1e-9) GROUP BY btw.slide),
glasses AS (SELECT bins.slide, arg_max(t, (n, -t)) AS glass, any_value(auto) AS auto
            FROM bins JOIN autos ON bins.slide = autos.slide AND t <= auto GROUP BY bins.slide),
levels AS (SELECT slide, auto, glass::INT AS glass, greatest(1, auto - glass)::INT AS span,
                  greatest(6, floor(glass + greatest(1, auto - glass) * 0.22::DOUBLE + 0.5))::INT AS relaxed,
                  greatest(glass + 2, floor(glass + greatest(1, auto - glass) * 0.1::DOUBLE + 0.5))::INT AS weak
           FROM glasses)"""


@query("overview_downsample", f"""
WITH {b.CELLS_SQL}
SELECT slide, x // 3 AS x, y // 3 AS y, floor(avg(r))::INT AS r, floor(avg(g))::INT AS g, floor(avg(b))::INT AS b
FROM cells GROUP BY slide, x // 3, y // 3""")
def overview_downsample(spark, sf):
    return raster.downsample_cells(b.cells(spark, sf), 3)


@query("tissue_levels", f"WITH {LEVELS_SQL} SELECT slide, auto, glass, span, relaxed, weak FROM levels")
def tissue_levels(spark, sf):
    return raster.otsu_levels(raster.tissue_score(b.cells(spark, sf)))


MASK_SQL = f"{b.CELLS_SQL}, mask AS (SELECT slide, x, y, (r < 220)::INT AS m FROM cells)"


def mask(spark, sf):
    return b.cells(spark, sf).select("slide", "x", "y", (F.col("r") < 220).cast("int").alias("m"))


def _square(source: str, radius: int, fn: str, out: str) -> str:
    k = 2 * radius + 1
    return f"""
{out}_n AS (SELECT slide, x + dx.i - {radius} AS x, y + dy.i - {radius} AS y, m
            FROM {source}, range({k}) dx(i), range({k}) dy(i)),
{out} AS (SELECT c.slide, c.x, c.y, {fn}(n.m) AS m FROM mask c JOIN {out}_n n USING (slide, x, y) GROUP BY ALL)"""


@query("morphology", f"""
WITH {MASK_SQL}, {_square('mask', 1, 'min', 'er')}, {_square('er', 1, 'max', 'op')},
{_square('op', 3, 'max', 'di')}, {_square('di', 3, 'min', 'cl')}
SELECT cl.slide, cl.x, cl.y, op.m AS opened, cl.m AS closed FROM cl JOIN op USING (slide, x, y)""")
def morphology(spark, sf):
    """Opening by one cell, then closing by three."""
    m = raster.opening(mask(spark, sf), 1).withColumnRenamed("m", "opened").withColumn("closed", F.col("opened"))
    return raster.closing(m, 3, "closed").select("slide", "x", "y", "opened", "closed")


def _win(source, c, rad):
    return f"""(SELECT avg(n.{c}) FROM f n WHERE n.slide = f.slide AND n.x BETWEEN f.x - {rad} AND f.x + {rad}
               AND n.y BETWEEN f.y - {rad} AND f.y + {rad})"""


@query("cell_features", f"""
WITH {b.CELLS_SQL}, f AS (SELECT *, {LUM} AS l, {SAT} AS s FROM cells),
wide AS (SELECT f.slide, f.x, f.y, any_value(f.r) AS r, any_value(f.g) AS g, any_value(f.b) AS b, any_value(f.l) AS l, any_value(f.s) AS s,
  avg(n.l) AS l4, avg(n.l * n.l) AS ll4, avg(n.s) AS s4, avg(n.s * n.s) AS ss4,
  avg(CASE WHEN abs(n.x - f.x) <= 2 AND abs(n.y - f.y) <= 2 THEN n.l END) AS l2,
  avg(CASE WHEN abs(n.x - f.x) <= 2 AND abs(n.y - f.y) <= 2 THEN n.l * n.l END) AS ll2,
  avg(CASE WHEN abs(n.x - f.x) <= 1 AND abs(n.y - f.y) <= 1 THEN n.l END) AS l1,
  avg(CASE WHEN abs(n.x - f.x) <= 1 AND abs(n.y - f.y) <= 1 THEN n.l * n.l END) AS ll1,
  coalesce(max(CASE WHEN n.x = f.x + 1 AND n.y = f.y THEN n.l END), any_value(f.l))
    - coalesce(max(CASE WHEN n.x = f.x - 1 AND n.y = f.y THEN n.l END), any_value(f.l)) AS gx,
  coalesce(max(CASE WHEN n.y = f.y + 1 AND n.x = f.x THEN n.l END), any_value(f.l))
    - coalesce(max(CASE WHEN n.y = f.y - 1 AND n.x = f.x THEN n.l END), any_value(f.l)) AS gy
  FROM f JOIN f n ON n.slide = f.slide AND n.x BETWEEN f.x - 4 AND f.x + 4 AND n.y BETWEEN f.y - 4 AND f.y + 4
  GROUP BY f.slide, f.x, f.y)
SELECT slide, x, y, {r('s', 9)} AS saturation, {r('255 - l', 9)} AS darkness, (r - g)::DOUBLE AS "redGreen", (b - g)::DOUBLE AS "blueGreen",
  {r('sqrt(greatest(0, ll1 - l1 * l1))', 4)} AS "detailFine", {r('sqrt(greatest(0, ll4 - l4 * l4))', 4)} AS "detailCoarse",
  {r('sqrt(greatest(0, ss4 - s4 * s4))', 4)} AS "saturationDetail", {r('2 * sqrt(greatest(0, ll2 - l2 * l2))', 4)} AS "localRange",
  {r('255 - l4', 9)} AS "neighbourDarkness", {r('s4', 9)} AS "neighbourSaturation", {r('sqrt(gx * gx + gy * gy)', 4)} AS gradient,
  (greatest(r, g, b) - least(r, g, b))::DOUBLE AS chroma
FROM wide""")
def cell_features(spark, sf):
    plain = ["saturation", "darkness", "neighbourDarkness", "neighbourSaturation"]
    d = b.rounded(raster.cell_features(b.cells(spark, sf)), *plain, digits=9)
    return b.rounded(d, *[f for f in raster.FEATURES if f not in plain], digits=4)




def _components_sql(source: str, out: str) -> str:
    """4-connected components: rows of cells as runs, runs joined where they touch."""
    return f"""
{out}_on AS MATERIALIZED (SELECT slide, x, y, y::BIGINT * 1048576 + x AS id,
           x - row_number() OVER (PARTITION BY slide, y ORDER BY x) AS g FROM {source} WHERE m = 1),
{out}_run AS MATERIALIZED (SELECT slide, y, g, min(x) AS x0, max(x) AS x1, min(id) AS id FROM {out}_on GROUP BY slide, y, g),
{out}_half AS MATERIALIZED (SELECT a.slide, a.id AS a, c.id AS b FROM {out}_run a JOIN {out}_run c
           ON a.slide = c.slide AND c.y = a.y + 1 AND a.x0 <= c.x1 AND a.x1 >= c.x0),
{out}_e AS MATERIALIZED (SELECT slide, a, b FROM {out}_half UNION ALL SELECT slide, b, a FROM {out}_half),
{out}_walk(slide, id, label) USING KEY (slide, id) AS (
  SELECT slide, id, id FROM {out}_run
  UNION
  SELECT e.slide, e.b, min(w.label) FROM {out}_walk w JOIN {out}_e e ON e.slide = w.slide AND e.a = w.id
  JOIN recurring.{out}_walk cur ON cur.slide = e.slide AND cur.id = e.b
  WHERE w.label < cur.label GROUP BY e.slide, e.b),
{out} AS (SELECT o.slide, o.x, o.y, w.label FROM {out}_on o JOIN {out}_run r ON r.slide = o.slide AND r.y = o.y AND r.g = o.g
          JOIN {out}_walk w ON w.slide = r.slide AND w.id = r.id)"""


@query("components", f"""
WITH RECURSIVE {MASK_SQL}, {_components_sql('mask', 'comp')}
SELECT slide, label, count(*) AS cells, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
FROM comp GROUP BY slide, label""")
def components(spark, sf):
    return cc.component_stats(cc.label_components(mask(spark, sf)))


@query("hysteresis", f"""
WITH RECURSIVE {SCORE_SQL},
mask AS (SELECT slide, x, y, (score >= 120)::INT AS m FROM scored),
weak AS MATERIALIZED (SELECT slide, x, y FROM scored WHERE score >= 14),
{_components_sql('mask', 'comp')},
grow(slide, x, y, label, d) USING KEY (slide, x, y) AS (
  SELECT slide, x, y, label, 0 FROM comp
  UNION
  SELECT w.slide, w.x, w.y, min(g.label), any_value(g.d) + 1
  FROM grow g, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy), weak w
  WHERE w.slide = g.slide AND w.x = g.x + dx AND w.y = g.y + dy
    AND NOT EXISTS (SELECT 1 FROM recurring.grow o WHERE o.slide = w.slide AND o.x = w.x AND o.y = w.y)
  GROUP BY w.slide, w.x, w.y)
SELECT slide, x, y, label FROM grow""")
def hysteresis(spark, sf):
    s = raster.tissue_score(b.cells(spark, sf))
    seeds = cc.label_components(s.select("slide", "x", "y", (F.col("score") >= 120).cast("int").alias("m")))
    return cc.hysteresis_grow(seeds, s.select("slide", "x", "y", (F.col("score") >= 14).cast("int").alias("m")))


@query("fill_holes", f"""
WITH RECURSIVE {MASK_SQL}, inv AS (SELECT slide, x, y, 1 - m AS m FROM mask), {_components_sql('inv', 'gap')},
box AS (SELECT slide, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mask GROUP BY slide),
holes AS (SELECT g.slide, label FROM gap g JOIN box ON box.slide = g.slide GROUP BY ALL
          HAVING count(*) <= 200 AND min(x) > any_value(x0) AND max(x) < any_value(x1) AND min(y) > any_value(y0) AND max(y) < any_value(y1))
SELECT m.slide, m.x, m.y, CASE WHEN h.label IS NOT NULL THEN 1 ELSE m.m END AS m
FROM mask m LEFT JOIN gap g ON g.slide = m.slide AND g.x = m.x AND g.y = m.y
LEFT JOIN holes h ON h.slide = m.slide AND h.label = g.label""")
def fill_holes(spark, sf):
    return cc.fill_holes(mask(spark, sf), 200, tile=32).select("slide", "x", "y", "m")


@query("artefacts", f"""
WITH RECURSIVE {MASK_SQL}, {_components_sql('mask', 'comp')},
c AS (SELECT slide, label, count(*) AS cells, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM comp GROUP BY ALL)
SELECT slide, label, cells, CASE WHEN cells < 70 THEN 'small'
  WHEN greatest(w, h) / least(w, h)::DOUBLE >= 2.5 AND least(w, h) * 20.0 < 400 THEN 'artefact' ELSE 'keep' END AS verdict
FROM c""")
def artefacts(spark, sf):
    comp = cc.component_stats(cc.label_components(mask(spark, sf)))
    slides = comp.select("slide").distinct().withColumns({"um_per_cell": F.lit(20.0), "min_cells": F.lit(70)})
    return cc.drop_artefacts(comp, slides, max_aspect=2.5).select("slide", "label", "cells", "verdict")


def slides_of(C, mpp=0.25, downsample=16.0):
    size = C.groupBy("slide").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return size.select("slide", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"),
                       (F.col("w") * downsample).alias("span_x"), (F.col("h") * downsample).alias("span_y"),
                       F.lit(mpp).alias("mpp"))


@query("tissue_fragments", f"""
WITH RECURSIVE {LEVELS_SQL},
mask AS MATERIALIZED (SELECT c.slide, x, y, (score > relaxed)::INT AS m FROM scored c JOIN levels l ON l.slide = c.slide),
wm AS (SELECT c.slide, x, y, (score > weak)::INT AS m FROM scored c JOIN levels l ON l.slide = c.slide),
{_square('mask', 1, 'min', 'er')}, {_square('er', 1, 'max', 'op')}, {_square('op', 3, 'max', 'di')}, {_square('di', 3, 'min', 'cl')},
{_square('wm', 1, 'min', 'wer')}, {_square('wer', 1, 'max', 'wop')},
{_components_sql('cl', 'comp')}, weak AS MATERIALIZED (SELECT slide, x, y FROM wop WHERE m = 1),
grow(slide, x, y, label, d) USING KEY (slide, x, y) AS (
  SELECT slide, x, y, label, 0 FROM comp
  UNION
  SELECT w.slide, w.x, w.y, min(g.label), any_value(g.d) + 1
  FROM grow g, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy), weak w
  WHERE w.slide = g.slide AND w.x = g.x + dx AND w.y = g.y + dy
    AND NOT EXISTS (SELECT 1 FROM recurring.grow o WHERE o.slide = w.slide AND o.x = w.x AND o.y = w.y)
  GROUP BY w.slide, w.x, w.y)
SELECT slide, label, count(*) AS cells, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM grow GROUP BY slide, label""")
def tissue_fragments(spark, sf):
    return cc.component_stats(tissue.tissue_fragments(tissue.tissue_masks(b.cells(spark, sf))))


@query("tissue_regions")
def tissue_regions(spark, sf):
    """The whole detector: outlines in slide pixels.  Ring tracing has no SQL twin; it
    is tested against rasters with known outlines."""
    C = cc.cut_lineage(b.cells(spark, sf))
    regions, _, _ = tissue.detect_tissue(C, slides_of(C), max_hole_um2=2000.0)
    return regions.select("slide", "id", "polygons")


@query("traced_area", f"""
WITH RECURSIVE {MASK_SQL}, {_components_sql('mask', 'comp')},
c AS (SELECT slide, label, x, y, count(*) OVER (PARTITION BY slide, label) AS n FROM comp),
quads AS (SELECT slide, label, x + dx.i AS qx, y + dy.i AS qy, count(*) AS k,
                 count(DISTINCT x) = 2 AND count(DISTINCT y) = 2 AS diagonal
          FROM c, range(2) dx(i), range(2) dy(i) GROUP BY ALL)
SELECT slide, label, {r('sum(CASE WHEN k = 1 THEN 0.125 WHEN k = 2 AND diagonal THEN 0.25 WHEN k = 2 THEN 0.5 WHEN k = 3 THEN 0.875 ELSE 1 END)::DOUBLE')} AS area
FROM quads GROUP BY slide, label""")
def traced_area(spark, sf):
    """Area of the unsimplified outlines, holes subtracted: fixed by the 2 x 2 blocks."""
    from patchframe.functions.geometry import area
    from patchframe.operators.contour import trace_regions

    L = cc.label_components(mask(spark, sf))
    t = trace_regions(L, ["slide", "label"], 0.0, 0.0).withColumn("a", area(F.array("rings")))
    return t.groupBy("slide", "label").agg(b.fixed(F.sum("a")).alias("area"))


@query("similar_regions", f"""
WITH RECURSIVE {b.patches_sql()},
th AS (SELECT slide, min(v) AS threshold FROM (SELECT slide, embedding[3]::DOUBLE AS v,
         row_number() OVER (PARTITION BY slide ORDER BY embedding[3]) - 1 AS i, count(*) OVER (PARTITION BY slide) AS n FROM patches)
       WHERE i = floor(0.7::DOUBLE * (n - 1) + 0.5) GROUP BY slide),
mask AS (SELECT p.slide, (x // 100)::INT AS x, (y // 100)::INT AS y, (embedding[3]::DOUBLE > threshold)::INT AS m
         FROM patches p JOIN th ON th.slide = p.slide),
{_components_sql('mask', 'comp')}
SELECT slide, label, x, y, count(*) OVER (PARTITION BY slide, label) AS patches FROM comp
QUALIFY count(*) OVER (PARTITION BY slide, label) >= 4""")
def similar_regions(spark, sf):
    return _similar(spark, sf)[1].select("slide", "label", "x", "y", "patches")


def _similar(spark, sf):
    E = b.expression(spark, sf)
    f = E.select("slide", "patch_id", F.col("values")[2].cast("double").alias("value"))
    P = E.select("slide", "patch_id", "x", "y", "side")
    cut = stats.percentile_threshold(f, 70)
    return tissue.similar_regions(f, lattice.lattice_of(P), lattice.lattice_meta(P), cut)


@query("background_samples", f"""
WITH {LEVELS_SQL},
cand AS (SELECT s.slide, x, y, row_number() OVER (PARTITION BY s.slide ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY s.slide) AS n
         FROM scored s JOIN levels l ON l.slide = s.slide
         WHERE score <= greatest(glass, floor((glass + weak) / 2.0 + 0.5)) AND NOT (x BETWEEN 8 AND 31 AND y BETWEEN 4 AND 27)),
rg AS (SELECT slide, count(*) AS base FROM (SELECT DISTINCT slide FROM scored), range(2) t(i) GROUP BY slide)
SELECT cand.slide, x, y, 0 AS label, (base + (k // greatest(1, ceil(n / 300.0))) % 8)::INT AS "group"
FROM cand JOIN rg ON rg.slide = cand.slide WHERE k % greatest(1, ceil(n / 300.0)) = 0
UNION ALL
SELECT slide, x, y, label, grp FROM (
  SELECT slide, x, y, CASE WHEN x < 20 THEN 1 ELSE 0 END AS label, CASE WHEN x < 20 THEN 0 ELSE 1 END AS grp,
         row_number() OVER (PARTITION BY slide, x < 20 ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY slide, x < 20) AS n
  FROM scored WHERE x BETWEEN 8 AND 31 AND y BETWEEN 4 AND 27) WHERE k % greatest(1, ceil(n / 400.0)) = 0""")
def background_samples(spark, sf):
    return samples(spark, sf).select("slide", "x", "y", "label", "group")


def samples(spark, sf):
    from patchframe.functions.geometry import rect_ring

    C = cc.cut_lineage(b.cells(spark, sf))
    lit = lambda *v: [F.lit(float(c)) for c in v]
    box = lambda i, label, *v: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"),
                                        F.array(F.array(rect_ring(*lit(*v)))).alias("polygons"))
    both = F.explode(F.array(box("a", 1, 8 * 16, 4 * 16, 20 * 16, 28 * 16), box("b", 0, 20 * 16, 4 * 16, 32 * 16, 28 * 16)))
    R = C.select("slide").distinct().select("slide", both.alias("r")).select(
        "slide", "r.*", F.lit("Polygon").alias("geom_type"))
    return tissue.collect_samples(C, R, slides_of(C), max_per_region=400, background_samples=300)[0]
