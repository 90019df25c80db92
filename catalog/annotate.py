"""Regions as documents: classes, summaries, edit logs, cell-set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.operators import annotations as an

from . import base as b
from .base import query, r
from .fields import ANNOTATIONS_SQL, annotations


@query("annotation_summary", f"""
WITH {ANNOTATIONS_SQL},
a AS (SELECT slide, id, class_id, source, locked, side * side AS area FROM squares
      UNION ALL SELECT slide, id, class_id, source, locked, 0.0 FROM dots)
SELECT slide, coalesce(class_id, '(none)') AS class_id, count(*) AS n, {r('sum(area)', 3)} AS area,
       sum(locked::INT)::BIGINT AS locked, sum((source = 'model')::INT)::BIGINT AS by_model,
       sum((source = 'human')::INT)::BIGINT AS by_human, coalesce(class_id, '(none)') = '__roi__' AS is_roi
FROM a GROUP BY slide, class_id""")
def annotation_summary(spark, sf):
    return b.rounded(an.annotation_summary(annotations(spark, sf)), "area", digits=3)


@query("replace_results", f"""
WITH {ANNOTATIONS_SQL},
a AS (SELECT slide, id, source, locked FROM squares UNION ALL SELECT slide, id, source, locked FROM dots)
SELECT slide, id, source FROM a WHERE NOT (source = 'model' AND NOT locked AND slide IN (SELECT slide FROM sup WHERE k % 2 = 0))
UNION ALL SELECT slide, 'new' || k, 'model' FROM sup WHERE k % 2 = 0""")
def replace_results(spark, sf):
    R = annotations(spark, sf)
    new = R.filter("geom_type = 'Polygon'").withColumn("k", F.substring("id", 2, 20).cast("bigint")).filter("k % 2 = 0").select(
        "slide", F.concat(F.lit("new"), F.col("k").cast("string")).alias("id"), F.lit("model").alias("source"), F.lit(False).alias("locked"))
    return an.replace_results(R.select("slide", "id", "source", "locked"), new, F.col("source") == "model").select("slide", "id", "source")


@query("mark_regions", f"""
WITH {ANNOTATIONS_SQL}
SELECT slide, id, CASE WHEN k % 5 = 0 AND NOT locked THEN 'artefact' ELSE class_id END AS class_id,
       CASE WHEN k % 5 = 0 AND NOT locked THEN 'human' ELSE source END AS source FROM squares""")
def mark_regions(spark, sf):
    R = annotations(spark, sf).filter("geom_type = 'Polygon'").select("slide", "id", "class_id", "source", "locked")
    ids = R.filter(F.substring("id", 2, 20).cast("bigint") % 5 == 0).select("slide", "id")
    return an.mark_regions(R, ids, "artefact").select("slide", "id", "class_id", "source")


# Events as an edit log: user = annotation, event = entry in order.
LOG_SQL = """
log AS (SELECT 'd' || user_id % 7 AS slide, event_id AS seq, 'u' || user_id AS id,
               CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'updated' END AS op,
               props AS after_ FROM events)"""


def edit_log(spark, sf):
    e = b.table(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("updated")
    return e.select(
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("slide"), F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), op.alias("op"),
        F.lit(None).cast("string").alias("before"), F.col("props").alias("after"))


@query("replay_changes", f"""
WITH {LOG_SQL}, l AS (SELECT slide, id, arg_max(op, seq) AS op, arg_max(after_, seq) AS state FROM log GROUP BY ALL)
SELECT slide, id, state FROM l WHERE op <> 'removed'""")
def replay_changes(spark, sf):
    return an.replay_changes(edit_log(spark, sf))


@query("undo_changes", f"""
WITH {LOG_SQL}, cut AS (SELECT max(seq) - 100 AS c FROM log),
l AS (SELECT slide, seq, id, CASE op WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE op END AS op, after_ FROM log, cut WHERE seq > c)
SELECT slide, (SELECT max(seq) FROM log) - seq + 1 AS seq, op, id, after_ AS before FROM l""")
def undo_changes(spark, sf):
    """Inverse entries of the last hundred edits."""
    log = edit_log(spark, sf)
    top = log.agg(F.max("seq")).first()[0]
    return an.inverse_changes(log, top - 100, 1).select("slide", "seq", "op", "id", "before")


@query("assign_class", f"""
WITH {ANNOTATIONS_SQL}
SELECT slide, 'updated' AS op, id, class_id AS before, 'stroma' AS after FROM squares
WHERE k % 3 <> 0 AND class_id IS DISTINCT FROM 'stroma'""")
def assign_class(spark, sf):
    R = annotations(spark, sf).filter("geom_type = 'Polygon'")
    ids = R.filter(F.substring("id", 2, 20).cast("bigint") % 3 != 0)
    return an.assign_class_log(R, ids, "stroma", 1).select(
        "slide", "op", "id", F.col("before.class_id").alias("before"), F.col("after.class_id").alias("after"))


@query("ensure_classes", """
WITH have AS (SELECT * FROM (VALUES (0, 'src-1', 'SRC 1'), (1, 'src10', 'Other'), (2, 'lang-en', 'lang en')) v(ordinal, class_id, name)),
names AS (SELECT source AS name, min(doc_id) AS seq FROM documents GROUP BY source
          UNION ALL SELECT 'Lang ' || lang, min(doc_id) + 1000000000 FROM documents GROUP BY lang),
fresh AS (SELECT name, seq, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s
          FROM names WHERE lower(name) NOT IN (SELECT lower(name) FROM have))
SELECT ordinal::INT AS ordinal, class_id, name FROM have
UNION ALL
SELECT (2 + row_number() OVER (ORDER BY seq))::INT, CASE WHEN s IN (SELECT class_id FROM have) THEN s || '-2' ELSE s END, name FROM fresh""")
def ensure_classes(spark, sf):
    d = b.table(spark, sf, "documents")
    have = spark.createDataFrame([(0, "src-1", "SRC 1"), (1, "src10", "Other"), (2, "lang-en", "lang en")],
                                 "ordinal int, class_id string, name string")
    names = d.select(F.col("source").alias("name"), F.col("doc_id").alias("seq")).unionByName(
        d.select(F.concat(F.lit("Lang "), "lang").alias("name"), (F.col("doc_id") + 1000000000).alias("seq")))
    return an.ensure_classes(names, have)


# Region cells of the embeddings lattice: a region per label, cells its patches.
def _cells(spark, sf):
    E = b.expression(spark, sf)
    return E.select("slide", F.concat(F.lit("r"), F.col("label").cast("string")).alias("id"), F.col("label").alias("seq"),
                    (F.col("label") % 3).cast("string").alias("class_id"), (F.col("label") == 9).alias("locked"),
                    F.floor(F.col("x") / 100).cast("int").alias("cx"), F.floor(F.col("y") / 100).cast("int").alias("cy"))


CELLS_SQL = f"""{b.patches_sql()},
rc AS (SELECT slide, 'r' || label AS id, label::INT AS seq, (label % 3)::VARCHAR AS class_id, label = 9 AS locked,
              (x // 100)::INT AS cx, (y // 100)::INT AS cy FROM patches),
stroke AS (SELECT slide, cx, cy FROM rc WHERE cx BETWEEN 4 AND 7 AND cy BETWEEN 2 AND 5)"""


def _stroke(R):
    return R.filter("cx BETWEEN 4 AND 7 AND cy BETWEEN 2 AND 5").select("slide", "cx", "cy", F.lit("0").alias("class_id"))


@query("cell_set_algebra", f"""
WITH {CELLS_SQL}, a AS (SELECT DISTINCT slide, cx, cy FROM rc WHERE class_id = '0')
SELECT 'union' AS op, slide, cx, cy FROM (SELECT * FROM a UNION SELECT * FROM stroke)
UNION ALL SELECT 'subtract', * FROM (SELECT * FROM a EXCEPT SELECT * FROM stroke)
UNION ALL SELECT 'intersect', * FROM (SELECT * FROM a INTERSECT SELECT * FROM stroke)""")
def cell_set_algebra(spark, sf):
    R = _cells(spark, sf)
    a, s = R.filter("class_id = '0'"), _stroke(R)
    parts = {"union": an.cells_union(a, s), "subtract": an.cells_subtract(a, s), "intersect": an.cells_intersect(a, s)}
    out = None
    for op, d in parts.items():
        d = d.select(F.lit(op).alias("op"), "slide", "cx", "cy")
        out = d if out is None else out.unionByName(d)
    return out


@query("dissolve_touching", f"""
WITH {CELLS_SQL},
t AS (SELECT DISTINCT rc.slide, id, seq FROM rc JOIN stroke USING (slide, cx, cy) WHERE NOT locked AND class_id = '0'),
k AS (SELECT slide, arg_min(id, seq) AS keep FROM t GROUP BY slide)
SELECT rc.slide, coalesce(CASE WHEN t.id IS NOT NULL THEN keep END, rc.id) AS id, cx, cy
FROM rc LEFT JOIN t ON t.slide = rc.slide AND t.id = rc.id LEFT JOIN k ON k.slide = rc.slide
UNION SELECT stroke.slide, keep, cx, cy FROM stroke LEFT JOIN k ON k.slide = stroke.slide""")
def dissolve_touching(spark, sf):
    R = _cells(spark, sf)
    return an.dissolve_touching(R, _stroke(R)).select("slide", "id", "cx", "cy")


@query("subtract_region", f"""
WITH {CELLS_SQL}
SELECT slide, id, cx, cy FROM rc WHERE locked OR (slide, cx, cy) NOT IN (SELECT (slide, cx, cy) FROM stroke)""")
def subtract_region(spark, sf):
    R = _cells(spark, sf)
    return an.subtract_region(R, _stroke(R)).select("slide", "id", "cx", "cy")


# New objects: 5 x 4 blocks of the lattice; neighbours: the label regions.
@query("non_overlap", f"""
WITH RECURSIVE {CELLS_SQL},
nw AS (SELECT slide, (cx // 5 || '_' || cy // 4) AS id, cx, cy FROM rc),
sz AS (SELECT slide, id, count(*) AS other FROM rc WHERE NOT locked AND class_id <> '__roi__' AND seq < 4 GROUP BY ALL),
own AS (SELECT slide, id, count(*) AS own FROM nw GROUP BY ALL),
lft AS MATERIALIZED (SELECT nw.slide, nw.id, cx, cy, own FROM nw JOIN own USING (slide, id) WHERE NOT EXISTS (
  SELECT 1 FROM rc JOIN sz ON sz.slide = rc.slide AND sz.id = rc.id
  WHERE rc.slide = nw.slide AND rc.cx = nw.cx AND rc.cy = nw.cy AND rc.seq < 4 AND other <= own * 8)),
walk(slide, id, cx, cy, label) USING KEY (slide, id, cx, cy) AS (
  SELECT slide, id, cx, cy, cy * 1048576 + cx FROM lft
  UNION
  SELECT c.slide, c.id, c.cx, c.cy, min(w.label) FROM walk w JOIN lft c ON c.slide = w.slide AND c.id = w.id
    AND abs(c.cx - w.cx) + abs(c.cy - w.cy) = 1
  JOIN recurring.walk cur ON cur.slide = c.slide AND cur.id = c.id AND cur.cx = c.cx AND cur.cy = c.cy
  WHERE w.label < cur.label GROUP BY ALL),
p AS (SELECT slide, id, label, count(*) AS n FROM walk GROUP BY ALL),
best AS (SELECT slide, id, arg_max(label, (n, -label)) AS label, max(n) AS n FROM p GROUP BY ALL)
SELECT walk.slide, walk.id, cx, cy FROM walk JOIN best ON walk.slide = best.slide AND walk.id = best.id AND walk.label = best.label
JOIN own ON own.slide = walk.slide AND own.id = walk.id WHERE n > own * 0.1""")
def non_overlap(spark, sf):
    R = _cells(spark, sf)
    block = F.concat_ws("_", F.floor(F.col("cx") / 5).cast("string"), F.floor(F.col("cy") / 4).cast("string"))
    new = R.select("slide", block.alias("id"), "cx", "cy")
    return an.non_overlap(new, R.filter("seq < 4"))
