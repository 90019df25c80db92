"""Enrichment, gradients, modules, thresholds, surveys, quantisation, atlas."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.operators import atlas, enrichment, expression, gradient, halves, joins, quantise, signatures, stats

from . import base as b
from .base import query, r

# Three modules over gene positions; the last has a zero weight (counts as one), the
# second a gene no map has.
MODULES = [
    (0, "rim", "g1", 1.0), (0, "rim", "g2", 0.5), (0, "rim", "g3", -1.0), (0, "rim", "g4", 2.0),
    (1, "core", "g10", 1.0), (1, "core", "g20", 1.0), (1, "core", "g30", 1.0), (1, "core", "g99", 1.0),
    (2, "seam", "g5", 0.0), (2, "seam", "g6", 1.0),
    *[(3, "broad", f"g{i}", 1.0 if i % 2 else -0.5) for i in range(40, 52)],
]
MODULES_SQL = f"modules AS (SELECT * FROM {b.values_sql(MODULES)} t(sig_idx, name, gene, weight))"

AXES = [("s0", 1, 50.0, 50.0, 2450.0, 950.0, 220.0), ("s0", 2, 2400.0, 500.0, 100.0, 500.0, 160.0),
        ("s1", 1, 50.0, 50.0, 2450.0, 950.0, 220.0)]


def modules(spark):
    rows = [(i, n, g, float(w), None) for i, n, g, w in MODULES]
    return spark.createDataFrame(rows, "sig_idx int, name string, gene string, weight double, cells bigint")


def axes(E):
    """Two arrows on every slide of the map."""
    s = E.select("slide").distinct()
    two = F.explode(F.array(
        F.struct(F.lit(1).alias("axis_id"), F.lit(50.0).alias("ax"), F.lit(50.0).alias("ay"),
                 F.lit(2450.0).alias("bx"), F.lit(950.0).alias("by"), F.lit(220.0).alias("width")),
        F.struct(F.lit(2).alias("axis_id"), F.lit(2400.0).alias("ax"), F.lit(500.0).alias("ay"),
                 F.lit(100.0).alias("bx"), F.lit(500.0).alias("by"), F.lit(160.0).alias("width")),
    ))
    return s.select("slide", two.alias("a")).select("slide", "a.*")


AXES_SQL = """
axes AS (
  SELECT DISTINCT slide, axis_id, ax, ay, bx, by_, width
  FROM patches, (VALUES (1, 50.0::DOUBLE, 50.0::DOUBLE, 2450.0::DOUBLE, 950.0::DOUBLE, 220.0::DOUBLE),
                        (2, 2400.0, 500.0, 100.0, 500.0, 160.0)) v(axis_id, ax, ay, bx, by_, width)),
proj AS (
  SELECT p.slide, axis_id, patch_id, width,
         ((x + side / 2.0 - ax) * (bx - ax) + (y + side / 2.0 - ay) * (by_ - ay))
           / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS t,
         abs((x + side / 2.0 - ax) * (by_ - ay) - (y + side / 2.0 - ay) * (bx - ax))
           / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS perp
  FROM patches p JOIN axes a ON p.slide = a.slide),
corridor AS (SELECT * FROM proj WHERE t >= 0 AND t <= 1 AND perp <= width)"""


@query("differential_expression", f"""
WITH {b.LONG_SQL}, src AS (SELECT slide, gene_idx, value, label = 0 AS inside FROM long),
{b.mw_sql('src', 'slide, gene_idx')}, {b.bh_sql('tested', 'slide', 'gene_idx')}
SELECT slide, gene_idx, 'g' || gene_idx AS gene, {r('mean')} AS mean, {r('mean_in')} AS mean_in,
       {r('mean_out')} AS mean_out, {r('diff')} AS diff, {r('auc')} AS auc, {r('p')} AS p, {r('q')} AS q,
       n_in, n_out
FROM adjusted""")
def differential_expression(spark, sf):
    E = b.expression(spark, sf)
    d = enrichment.differential_expression(E, b.genes(E), on_small="drop")
    return b.rounded(d, "mean", "mean_in", "mean_out", "diff", "auc", "p", "q")


# A rectangle and an L-shape with a hole, in slide pixels; the edge table is derived
# from the same rings in both engines.
RINGS = [
    ("a", 0, [(120.0, 130.0), (820.0, 130.0), (820.0, 560.0), (120.0, 560.0)]),
    ("b", 0, [(1010.0, 90.0), (2230.0, 90.0), (2230.0, 930.0), (1650.0, 930.0), (1650.0, 420.0), (1010.0, 420.0)]),
    ("b", 1, [(1830.0, 220.0), (2060.0, 220.0), (2060.0, 640.0), (1830.0, 640.0)]),
]


def regions(E):
    """The two drawn regions on every slide of the map."""
    def ring(pts):
        return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [*pts, pts[0]]])

    def poly(rid):
        return F.array(F.array(*[ring(p) for i, _, p in RINGS if i == rid]))

    both = F.explode(F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(c).alias("class_id"), poly(i).alias("polygons")) for i, c in
        (("a", "stroma"), ("b", "crypt"))]))
    return E.select("slide").distinct().select("slide", both.alias("r")).select(
        "slide", "r.*", F.lit("Polygon").alias("geom_type"))


_edges = [(i, *p, *q) for i, _, pts in RINGS for p, q in zip(pts, [*pts[1:], pts[0]])]
EDGES_SQL = f"edges AS (SELECT * FROM {b.values_sql(_edges)} t(id, x1, y1, x2, y2))"
INSIDE_SQL = """
crossings AS (
  SELECT p.slide, p.patch_id, e.id, count(*) AS k
  FROM patches p JOIN edges e
    ON (e.y1 > p.y + p.side / 2.0) <> (e.y2 > p.y + p.side / 2.0)
   AND p.x + p.side / 2.0 < (e.x2 - e.x1) * (p.y + p.side / 2.0 - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL),
hits AS (SELECT slide, patch_id, id FROM crossings WHERE k % 2 = 1)"""


@query("region_enrichment", f"""
WITH {b.LONG_SQL}, {EDGES_SQL}, {INSIDE_SQL},
src AS (SELECT slide, gene_idx, value, EXISTS (SELECT 1 FROM hits h WHERE h.slide = long.slide
               AND h.patch_id = long.patch_id) AS inside FROM long),
{b.mw_sql('src', 'slide, gene_idx')}, floored AS (SELECT * FROM tested WHERE mean >= 0.002),
{b.bh_sql('floored', 'slide', 'gene_idx')}
SELECT slide, gene_idx, 'g' || gene_idx AS gene, {r('mean')} AS mean, {r('mean_in')} AS mean_in,
       {r('mean_out')} AS mean_out, {r('diff')} AS diff, {r('auc')} AS auc, {r('p')} AS p, {r('q')} AS q,
       n_in, n_out
FROM adjusted""")
def region_enrichment(spark, sf):
    """Drawn regions, an expression floor before the correction."""
    E = b.expression(spark, sf).drop("inside", "label")
    flagged = joins.flag_inside(E, regions(E))
    d = enrichment.differential_expression(flagged, b.genes(E), min_expression=0.002, on_small="drop")
    return b.rounded(d, "mean", "mean_in", "mean_out", "diff", "auc", "p", "q")


def codes(E, G):
    st = expression.survey_genes(E)
    keep = quantise.choose_genes(st, min_expression=float("-inf"))
    return quantise.quantise(E, G, keep)


STATS_SQL = """
stats AS (
  SELECT slide, gene_idx, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi,
         count(*) AS n
  FROM long GROUP BY slide, gene_idx),
ranges AS (
  SELECT *, least(0.0::FLOAT, lo::FLOAT)::FLOAT AS zero,
         ((greatest(hi::FLOAT, (least(0.0::FLOAT, lo::FLOAT) + 1e-6::FLOAT)::FLOAT)
           - least(0.0::FLOAT, lo::FLOAT))::FLOAT / 255.0::DOUBLE)::FLOAT AS scale
  FROM stats),
coded AS (
  SELECT l.slide, l.patch_id, l.label, l.gene_idx, l.value, r.scale, r.zero,
         greatest(0, least(255, round_even((l.value::FLOAT - r.zero)::FLOAT::DOUBLE / r.scale::DOUBLE, 0)))::DOUBLE AS code
  FROM long l JOIN ranges r USING (slide, gene_idx))"""


@query("code_enrichment", f"""
WITH {b.LONG_SQL}, {STATS_SQL},
src AS (SELECT slide, gene_idx, code * scale::DOUBLE + zero::DOUBLE AS value, label = 0 AS inside FROM coded),
{b.mw_sql('src', 'slide, gene_idx')}, {b.bh_sql('tested', 'slide', 'gene_idx')}
SELECT slide, gene_idx, 'g' || gene_idx AS gene, {r('mean')} AS mean, {r('mean_in')} AS mean_in,
       {r('mean_out')} AS mean_out, {r('diff')} AS diff, {r('auc')} AS auc, {r('p')} AS p, {r('q')} AS q,
       n_in, n_out
FROM adjusted""")
def code_enrichment(spark, sf):
    """The byte-coded map: histograms of codes, decoded after aggregation."""
    E = b.expression(spark, sf)
    E8, G8, _ = codes(E, b.genes(E))
    E8 = E8.join(E.select("slide", "patch_id", "inside"), ["slide", "patch_id"])
    d = enrichment.differential_expression(E8, G8, on_small="drop")
    return b.rounded(d, "mean", "mean_in", "mean_out", "diff", "auc", "p", "q")


# Rounding to half precision: ten bits after the leading one, to even.
HALF_SQL = """
halved AS (
  SELECT slide, gene_idx, label = 0 AS inside,
         round_even(value / pow(2.0::DOUBLE, e - 10), 0) * pow(2.0::DOUBLE, e - 10) AS value
  FROM (SELECT *, CASE WHEN value = 0 THEN -14 ELSE greatest(-14, floor(log2(abs(value)))) END AS e FROM long))"""


@query("half_enrichment", f"""
WITH {b.LONG_SQL}, {HALF_SQL}, {b.mw_sql('halved', 'slide, gene_idx')}, {b.bh_sql('tested', 'slide', 'gene_idx')}
SELECT slide, gene_idx, 'g' || gene_idx AS gene, {r('mean')} AS mean, {r('mean_in')} AS mean_in,
       {r('mean_out')} AS mean_out, {r('diff')} AS diff, {r('auc')} AS auc, {r('p')} AS p, {r('q')} AS q,
       n_in, n_out
FROM adjusted""")
def half_enrichment(spark, sf):
    """The map in half precision: counted on its bit patterns."""
    E = b.expression(spark, sf)
    d = enrichment.differential_expression(halves.pack_halves(E), b.genes(E), on_small="drop")
    return b.rounded(d, "mean", "mean_in", "mean_out", "diff", "auc", "p", "q")


@query("mann_whitney_rank", f"""
WITH {b.LONG_SQL}, src AS (SELECT slide, gene_idx, value, label = 0 AS inside FROM long),
{b.mw_sql('src', 'slide, gene_idx')}
SELECT slide, gene_idx, {r('auc * n_in * n_out', 3)} AS u, n_in, n_out FROM tested""")
def mann_whitney_rank(spark, sf):
    long = expression.long_values(b.expression(spark, sf), "inside")
    u = stats.mann_whitney_rank(long, ["slide", "gene_idx"], "value", F.col("inside"))
    return u.select("slide", "gene_idx", b.fixed("u", 3).alias("u"), "n_in", "n_out")


SCORES_SQL = f"""
{b.LONG_SQL}, {MODULES_SQL},
gstats AS (SELECT slide, gene_idx, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY ALL),
scores AS (
  SELECT l.slide, l.patch_id, any_value(l.label) AS label, m.sig_idx::INT AS sig_idx, m.name,
         sum((CASE WHEN abs(weight) > 1e-9 THEN weight ELSE 1.0 END)::DOUBLE * (l.value - s.mean) / s.sd)
           / sum(abs((CASE WHEN abs(weight) > 1e-9 THEN weight ELSE 1.0 END)::DOUBLE)) AS score
  FROM long l JOIN gstats s USING (slide, gene_idx) JOIN modules m ON m.gene = 'g' || l.gene_idx
  WHERE s.sd >= 1e-6
  GROUP BY l.slide, l.patch_id, m.sig_idx, m.name)"""


@query("signature_scores", f"""
WITH {SCORES_SQL}
SELECT slide, patch_id, sig_idx, name, {r('score')} AS score FROM scores""")
def signature_scores(spark, sf):
    E = b.expression(spark, sf)
    return b.rounded(signatures.score_signatures(E, b.genes(E), modules(spark)), "score")


@query("differential_signatures", f"""
WITH {SCORES_SQL}, src AS (SELECT slide, sig_idx, name, score AS value, label = 0 AS inside FROM scores),
{b.mw_sql('src', 'slide, sig_idx, name')}, {b.bh_sql('tested', 'slide', 'sig_idx')}
SELECT slide, sig_idx, name, {r('mean_in')} AS mean_in, {r('mean_out')} AS mean_out, {r('diff')} AS diff,
       {r('auc')} AS auc, {r('p')} AS p, {r('q')} AS q, n_in, n_out
FROM adjusted""")
def differential_signatures(spark, sf):
    E = b.expression(spark, sf)
    d = enrichment.differential_signatures(E, b.genes(E), modules(spark), on_small="drop")
    return b.rounded(d, "mean_in", "mean_out", "diff", "auc", "p", "q")


@query("signature_coverage", f"""
WITH {b.LONG_SQL}, {MODULES_SQL},
g AS (SELECT DISTINCT slide, 'g' || gene_idx AS gene FROM long),
c AS (SELECT slide, sig_idx::INT AS sig_idx, name, count(*) AS found
      FROM modules JOIN g USING (gene) GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT sig_idx, count(*) AS total FROM modules GROUP BY sig_idx)
SELECT slide, c.sig_idx, name, found, total,
       row_number() OVER (PARTITION BY slide ORDER BY found DESC, c.sig_idx)::INT AS rank,
       row_number() OVER (PARTITION BY slide ORDER BY found DESC, c.sig_idx) = 1 AND found >= 8 AS is_default
FROM c JOIN t USING (sig_idx)""")
def signature_coverage(spark, sf):
    E = b.expression(spark, sf)
    return signatures.usable_signatures(b.genes(E), modules(spark))


@query("module_from_enrichment", f"""
WITH {b.LONG_SQL}, src AS (SELECT slide, gene_idx, value, label = 0 AS inside FROM long),
{b.mw_sql('src', 'slide, gene_idx')},
m AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY abs(auc - 0.5) DESC, gene_idx) AS rank
      FROM tested WHERE abs(auc - 0.5) >= 0.05)
SELECT slide, 'g' || gene_idx AS gene, {r('floor((auc - 0.5) * 2 * 10000 + 0.5) / 10000', 4)} AS weight,
       rank::INT AS rank
FROM m WHERE rank <= 12""")
def module_from_enrichment(spark, sf):
    E = b.expression(spark, sf)
    d = enrichment.differential_expression(E, b.genes(E), on_small="drop")
    m = enrichment.module_from_enrichment("example", d, top=12, min_separation=0.05)
    return m.select("slide", "gene", b.fixed("weight", 4).alias("weight"), "rank")


@query("axis_corridor", f"""
WITH {b.patches_sql()}, {AXES_SQL}
SELECT slide, axis_id, patch_id, {r('t', 9)} AS t FROM corridor""")
def axis_corridor(spark, sf):
    E = b.expression(spark, sf)
    a = joins.patches_along(E.select("slide", "patch_id", "x", "y", "side"), axes(E))
    return a.select("slide", "axis_id", "patch_id", b.fixed("t", 9).alias("t"))


def _gradient_sql(source: str, key: str, floor: str, cols: str) -> str:
    return f"""
sized AS (SELECT *, count(*) OVER (PARTITION BY slide, axis_id) AS n FROM corridor),
ends AS (
  SELECT slide, axis_id, patch_id, n,
         rank() OVER (PARTITION BY slide, axis_id ORDER BY t)
           + (count(*) OVER (PARTITION BY slide, axis_id, t) - 1) / 2.0::DOUBLE AS rt,
         row_number() OVER (PARTITION BY slide, axis_id ORDER BY t, patch_id) AS up,
         row_number() OVER (PARTITION BY slide, axis_id ORDER BY t DESC, patch_id) AS down,
         greatest(1, floor(n / 3.0 + 0.5)) AS third
  FROM sized),
vals AS (
  SELECT e.*, {key}, l.value,
         rank() OVER (PARTITION BY e.slide, axis_id, {key} ORDER BY l.value)
           + (count(*) OVER (PARTITION BY e.slide, axis_id, {key}, l.value) - 1) / 2.0::DOUBLE AS rv
  FROM ends e JOIN {source} l ON e.slide = l.slide AND e.patch_id = l.patch_id),
grad AS (
  SELECT slide, axis_id, {key}, any_value(n)::BIGINT AS n, coalesce(corr(rv, rt), 0) AS rho, avg(value) AS mean,
         avg(CASE WHEN up <= third THEN value END) AS mean_start,
         avg(CASE WHEN down <= third THEN value END) AS mean_end
  FROM vals GROUP BY slide, axis_id, {key}),
tested AS (
  SELECT *, least(1.0, 2 * {b.sf_sql('abs(atanh(rho)) * sqrt(n - 3.0::DOUBLE)')}) AS p
  FROM grad WHERE n >= 8 {floor}),
{b.bh_sql('tested', 'slide, axis_id', key.split(',')[0])}
SELECT a.slide, a.axis_id, {cols}, a.n, {r('rho')} AS rho, {r('mean')} AS mean, {r('mean_start')} AS mean_start,
       {r('mean_end')} AS mean_end, {r('p')} AS p, {r('q')} AS q,
       {r('sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))', 6)} AS length_px
FROM adjusted a JOIN axes x ON a.slide = x.slide AND a.axis_id = x.axis_id"""


GRAD_COLS = ["n", "rho", "mean", "mean_start", "mean_end", "p", "q", "length_px"]


@query("gene_gradient", f"""
WITH {b.LONG_SQL}, {AXES_SQL},
{_gradient_sql('long', 'gene_idx', 'AND mean >= 0.0', "a.gene_idx, 'g' || a.gene_idx AS gene")}""")
def gene_gradient(spark, sf):
    E = b.expression(spark, sf)
    g = gradient.gene_gradient(E, b.genes(E), axes(E), min_expression=1e-300, on_small="drop")
    return b.rounded(g.select("slide", "axis_id", "gene_idx", "gene", *GRAD_COLS), *GRAD_COLS[1:])


@query("signature_gradient", f"""
WITH {SCORES_SQL}, {AXES_SQL}, sl AS (SELECT slide, patch_id, sig_idx, name, score AS value FROM scores),
{_gradient_sql('sl', 'sig_idx, name', '', 'a.sig_idx, a.name')}""")
def signature_gradient(spark, sf):
    E = b.expression(spark, sf)
    g = gradient.signature_gradient(E, b.genes(E), axes(E), modules(spark), on_small="drop")
    return b.rounded(g.select("slide", "axis_id", "sig_idx", "name", *GRAD_COLS), *GRAD_COLS[1:])


@query("module_from_gradient", f"""
WITH {b.LONG_SQL}, {AXES_SQL}, one AS (WITH
{_gradient_sql('long', 'gene_idx', '', "a.gene_idx, a.rho AS exact")}),
m AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY abs(exact) DESC, gene_idx) AS rank
      FROM one WHERE axis_id = 1 AND abs(exact) >= 0.05)
SELECT slide, 'g' || gene_idx AS gene, {r('floor(exact * 10000 + 0.5) / 10000', 4)} AS weight, rank::INT AS rank
FROM m WHERE rank <= 10""")
def module_from_gradient(spark, sf):
    E = b.expression(spark, sf)
    g = gradient.gene_gradient(E, b.genes(E), axes(E).filter("axis_id = 1"), on_small="drop")
    m = enrichment.module_from_gradient("along", g, top=10, min_rho=0.05)
    return m.select("slide", "gene", b.fixed("weight", 4).alias("weight"), "rank")


@query("robust_range", f"""
WITH {b.LONG_SQL},
o AS (SELECT slide, gene_idx, value, row_number() OVER (PARTITION BY slide, gene_idx ORDER BY value) - 1 AS i,
             count(*) OVER (PARTITION BY slide, gene_idx) AS n FROM long),
e AS (SELECT slide, gene_idx, min(CASE WHEN i = floor(0.02::DOUBLE * (n - 1) + 0.5) THEN value END) AS lo,
             min(CASE WHEN i = floor(0.98::DOUBLE * (n - 1) + 0.5) THEN value END) AS hi FROM o GROUP BY ALL)
SELECT slide, gene_idx, {r('CASE WHEN hi - lo <= 1e-9 THEN lo - 0.5 ELSE lo END')} AS lo,
       {r('CASE WHEN hi - lo <= 1e-9 THEN lo + 0.5 ELSE hi END')} AS hi
FROM e""")
def robust_range(spark, sf):
    d = stats.robust_range(expression.long_values(b.expression(spark, sf)), by=["slide", "gene_idx"])
    return b.rounded(d, "lo", "hi")


@query("percentile_threshold", f"""
WITH o AS (SELECT l_returnflag, l_extendedprice AS v,
                  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
                  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, {r('min(CASE WHEN i = floor(95 / 100.0::DOUBLE * (n - 1) + 0.5) THEN v END)', 2)} AS threshold
FROM o GROUP BY l_returnflag""")
def percentile_threshold(spark, sf):
    d = stats.percentile_threshold(b.table(spark, sf, "lineitem"), 95, "l_returnflag", "l_extendedprice")
    return b.rounded(d, "threshold", digits=2)


@query("gene_survey", f"""
WITH {b.LONG_SQL}, {STATS_SQL}
SELECT slide, gene_idx, {r('mean')} AS mean, {r('sd')} AS sd, {r('lo')} AS lo, {r('hi')} AS hi, n FROM stats""")
def gene_survey(spark, sf):
    return b.rounded(expression.survey_genes(b.expression(spark, sf)), "mean", "sd", "lo", "hi")


@query("choose_genes", f"""
WITH {b.LONG_SQL}, {STATS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY sd DESC, gene_idx) AS rk FROM stats WHERE mean >= 0)
SELECT slide, gene_idx, (row_number() OVER (PARTITION BY slide ORDER BY gene_idx) - 1)::INT AS new_idx
FROM k WHERE rk <= 20""")
def choose_genes(spark, sf):
    st = expression.survey_genes(b.expression(spark, sf))
    return quantise.choose_genes(st, min_expression=0.0, top=20).select("slide", "gene_idx", "new_idx")


@query("quantise_map", f"""
WITH {b.LONG_SQL}, {STATS_SQL}
SELECT slide, patch_id, gene_idx, code::BIGINT AS code,
       {r('code * scale::DOUBLE + zero::DOUBLE', 5)} AS decoded FROM coded""")
def quantise_map(spark, sf):
    E = b.expression(spark, sf)
    E8, G8, _ = codes(E, b.genes(E))
    c = expression.long_values(E8).withColumnRenamed("value", "code")
    return c.join(G8, ["slide", "gene_idx"]).select(
        "slide", "patch_id", "gene_idx", F.col("code").cast("bigint").alias("code"),
        b.fixed(F.col("code") * F.col("scale").cast("double") + F.col("zero").cast("double"), 5).alias("decoded"),
    )


@query("quantise_error", f"""
WITH {b.LONG_SQL}, {STATS_SQL}
SELECT slide, {r('avg(abs(code * scale::DOUBLE + zero::DOUBLE - value))')} AS mean_error,
       {r('max(abs(code * scale::DOUBLE + zero::DOUBLE - value))')} AS worst_error, count(*) AS n_values
FROM coded GROUP BY slide""")
def quantise_error(spark, sf):
    E = b.expression(spark, sf)
    return b.rounded(codes(E, b.genes(E))[2], "mean_error", "worst_error").withColumn(
        "n_values", F.col("n_values").cast("bigint"))


@query("gene_field", f"""
WITH {b.patches_sql()}
SELECT slide, patch_id, {r('embedding[18]::DOUBLE')} AS value, 'g17' AS label FROM patches""")
def gene_field(spark, sf):
    E = b.expression(spark, sf).drop("label")
    return b.rounded(expression.current_field(E, b.genes(E), gene="g17").withColumn(
        "value", F.col("value").cast("double")), "value")


_CELL_TYPES = """
obs AS (SELECT o_orderkey AS cell_id, c_mktsegment AS cell_type FROM orders JOIN customer ON o_custkey = c_custkey),
counts AS (SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS n
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query("atlas_signatures", f"""
WITH {_CELL_TYPES},
numbered AS (SELECT *, count(*) OVER (PARTITION BY cell_type) AS k FROM obs),
used AS (SELECT cell_id, cell_type, k AS cells FROM numbered WHERE k >= 200),
types AS (SELECT cell_type, max(cells) AS cells, count(*) AS n, row_number() OVER (ORDER BY cell_type) - 1 AS sig_idx
          FROM used GROUP BY cell_type),
depth AS (SELECT cell_id, sum(n) AS d FROM counts GROUP BY cell_id),
m AS (SELECT cell_type, gene, sum(ln(1 + c.n * 10000.0 / d)) AS s
      FROM used JOIN counts c USING (cell_id) JOIN depth USING (cell_id) GROUP BY ALL),
means AS (SELECT m.cell_type, gene, s / n AS mean, cells, sig_idx FROM m JOIN types USING (cell_type)),
lfc AS (SELECT *, mean - (sum(mean) OVER (PARTITION BY gene) - mean) / ((SELECT count(*) FROM types) - 1) AS l
        FROM means),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY l DESC, gene) AS rank
       FROM lfc WHERE mean > 0.1 AND l > 0)
SELECT sig_idx::INT AS sig_idx, cell_type AS name, gene, {r('l', 4)} AS weight, cells, rank::INT AS rank
FROM rk WHERE rank <= 40 QUALIFY count(*) OVER (PARTITION BY cell_type) >= 5""")
def atlas_signatures(spark, sf):
    o, c = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    obs = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"))
    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    counts = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("n"))
    s = atlas.atlas_signatures(obs, counts)
    return b.rounded(s, "weight", digits=4)


@query("shard_assign", """
WITH d AS (SELECT o_orderpriority AS slide, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority
                  ORDER BY o_orderkey) - 1 AS patch_id, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT slide, patch_id, o_orderkey, (patch_id // ceil(n / 7.0)::BIGINT + 1)::INT AS shard FROM d""")
def shard_assign(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("slide"), "o_orderkey")
    P = stats.row_numbers(o, "slide", F.floor(F.col("o_orderkey") / 4096), [F.col("o_orderkey")], "patch_id")
    return quantise.assign_shards(P, 7).select("slide", "patch_id", "o_orderkey", "shard")


# A run per order priority, its shards the order keys modulo four.  The first run lacks
# its last shard and the second disagrees about the side.
@query("shard_merge", """
WITH rows_ AS (SELECT o_orderpriority AS run, (o_orderkey % 4 + 1)::INT AS shard, o_orderkey // 4 AS k, o_orderkey
               FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderkey % 4 = 3)
                             AND NOT o_orderpriority LIKE '2%'),
n AS (SELECT run, shard, o_orderkey, row_number() OVER (PARTITION BY run, shard ORDER BY k) - 1 AS row_ FROM rows_),
s AS (SELECT run, shard, count(*) AS c FROM rows_ GROUP BY ALL),
st AS (SELECT a.run, a.shard, coalesce(sum(b.c), 0) AS start FROM s a LEFT JOIN s b
       ON a.run = b.run AND b.shard < a.shard GROUP BY ALL)
SELECT run, o_orderkey, (row_ + start)::BIGINT AS patch_id FROM n JOIN st USING (run, shard) WHERE run NOT LIKE '1%'""")
def shard_merge(spark, sf):
    return quantise.merge_shards(*_shards(spark, sf))[0].select("run", "o_orderkey", "patch_id")


def _shards(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("shard"),
        F.floor(F.col("o_orderkey") / 4).alias("k"), "o_orderkey",
    ).filter(~(F.col("run").startswith("1") & (F.col("shard") == 4)))
    rows = stats.row_numbers(o, ["run", "shard"], F.floor(F.col("k") / 4096), [F.col("k")], "row").drop("k")
    headers = o.groupBy("run", "shard").agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "of": F.lit(4),
        "side": F.when(F.col("run").startswith("2") & (F.col("shard") == 2), 112).otherwise(224),
    })
    return rows, headers


@query("shard_problems", """
SELECT DISTINCT o_orderpriority AS run, CASE WHEN o_orderpriority LIKE '1%' THEN 'shard 4 is missing'
       ELSE 'disagrees about side' END AS problem
FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""")
def shard_problems(spark, sf):
    return quantise.merge_shards(*_shards(spark, sf))[1]
