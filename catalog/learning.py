"""Hold-out splits, metrics, graphs, and the learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchframe.operators import components, graph, learn, tissue

from . import base as b
from . import raster as cells
from .base import query, r


def labelled(spark, sf):
    E = b.expression(spark, sf)
    return E.filter(F.col("label") < 3).select(
        "slide", "patch_id", F.struct("slide", "patch_id").alias("row"), F.col("values").alias("features"), "label",
        (F.col("x") + 50).cast("double").alias("px"), (F.col("y") + 50).cast("double").alias("py"))


@query("spatial_block_split", f"""
WITH {b.patches_sql()},
l AS (SELECT *, slide || ' ' || floor((x + 50) / 300.0)::BIGINT || ',' || floor((y + 50) / 300.0)::BIGINT AS g FROM patches WHERE label < 3),
f AS (SELECT g, row_number() OVER (ORDER BY min((slide, patch_id))) - 1 AS block_index, count(*) OVER () AS n FROM l GROUP BY g)
SELECT slide, patch_id, block_index::INT AS block_index,
       n >= 4 AND block_index % (CASE WHEN n = 2 THEN 2 ELSE 3 END) = (CASE WHEN n = 2 THEN 1 ELSE 2 END) AS held_out
FROM l JOIN f USING (g)""")
def spatial_block_split(spark, sf):
    return learn.spatial_block_split(labelled(spark, sf), 300.0).select("slide", "patch_id", "block_index", "held_out")


@query("confusion_metrics", f"""
WITH p AS (SELECT label::INT AS l, (vec_id * 7 % 10)::INT AS p FROM embeddings),
c AS (SELECT i.i::INT AS class, count(CASE WHEN l = i.i THEN 1 END) AS actual, count(CASE WHEN p = i.i THEN 1 END) AS predicted,
             count(CASE WHEN l = i.i AND p = i.i THEN 1 END) AS tp FROM p, range(10) i(i) GROUP BY i.i),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS pr, coalesce(tp / nullif(actual, 0), 0)::DOUBLE AS rc FROM c)
SELECT class, actual, predicted, {r('pr')} AS precision, {r('rc')} AS recall,
       {r('coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)')} AS f1,
       {r('(SELECT avg((l = p)::INT) FROM p)')} AS accuracy
FROM m""")
def confusion_metrics(spark, sf):
    e = b.table(spark, sf, "embeddings").select("label", (F.col("vec_id") * 7 % 10).alias("prediction"))
    m = learn.classification_metrics(e, 10)
    return b.rounded(m.select("class", "actual", "predicted", "precision", "recall", "f1", "accuracy"),
                     "precision", "recall", "f1", "accuracy")


def points(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


# The brute-force twin compares every pair, exactly as the definition does.
KNN_SQL = """
pairs AS (SELECT a.vec_id AS src, c.vec_id AS dst,
                 list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS d
          FROM embeddings a JOIN embeddings c ON a.vec_id <> c.vec_id),
nn AS (SELECT src, dst, d FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 15),
graph AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM nn)"""


@query("nearest_neighbours", f"""
WITH {KNN_SQL} SELECT src, dst, {r('sqrt(d)', 5)} AS distance FROM nn""")
def nearest_neighbours(spark, sf):
    return b.rounded(graph.nearest_neighbours(points(spark, sf), 15), "distance", digits=5)


@query("knn_graph", f"WITH {KNN_SQL} SELECT src, dst, 1.0::DOUBLE AS w FROM graph")
def knn_graph(spark, sf):
    return graph.knn_graph(points(spark, sf), 15)


@query("modularity", f"""
WITH {KNN_SQL},
e AS (SELECT a.label AS la, c.label AS lb FROM graph JOIN embeddings a ON a.vec_id = src JOIN embeddings c ON c.vec_id = dst),
t AS (SELECT label, count(*) AS s FROM (SELECT la AS label FROM e UNION ALL SELECT lb FROM e) GROUP BY label)
SELECT {r('(SELECT sum((la = lb)::INT) / count(*) FROM e) - sum(s * s) / power(sum(s), 2)')} AS modularity FROM t""")
def modularity(spark, sf):
    labels = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return b.rounded(graph.modularity(graph.knn_graph(points(spark, sf), 15), labels), "modularity")


@query("communities")
def communities(spark, sf):
    """Groups by greedy modularity; checked against planted partitions in the tests."""
    return graph.communities(graph.knn_graph(points(spark, sf), 15))


def _emb(spark, sf):
    E = b.expression(spark, sf)
    return E.select("slide", "patch_id", F.col("values").alias("vec"))


@query("pca_scores")
def pca_scores(spark, sf):
    """Rows only: solvers differ in the last digits; the tests check the invariants."""
    s = learn.pca_scores(_emb(spark, sf), k=8).scores
    return s.select("slide", "patch_id", F.posexplode("scores").alias("component", "score"))


@query("explained_variance", f"""
WITH m AS (SELECT i.i, avg(embedding[i.i]::DOUBLE) AS mu FROM embeddings, range(1, 65) i(i) GROUP BY i.i),
v AS (SELECT sum(power(embedding[i.i]::DOUBLE - mu, 2)) / (count(DISTINCT vec_id) - 1) AS total FROM embeddings, m i GROUP BY ALL)
SELECT {r('total', 6)} AS total_variance FROM v""")
def explained_variance(spark, sf):
    """The components' variances and their shares must give the total variance back."""
    c = learn.pca_scores(_emb(spark, sf), k=64)
    total = F.lit(0.0)
    per = c.scores.select(F.posexplode("scores").alias("i", "s")).groupBy("i").agg(F.var_samp("s").alias("v"))
    return per.agg(b.fixed(F.sum("v") + total, 6).alias("total_variance"))


@query("kmeans")
def kmeans(spark, sf):
    labelled_, _, _ = learn.kmeans(_emb(spark, sf), 8, column="vec")
    return labelled_.select("slide", "patch_id", "label")


@query("discover")
def discover(spark, sf):
    return learn.discover(_emb(spark, sf), 6)[0].select("slide", "patch_id", "label")


@query("train_head")
def train_head(spark, sf):
    """Class probabilities of every patch from a head trained on three classes."""
    E = b.expression(spark, sf).withColumnRenamed("values", "features")
    m = learn.train_head(labelled(spark, sf), ["a", "b", "c"], 300.0, population=E)
    return learn.predict_and_blend(m, E).select("slide", "patch_id", "class", b.fixed("prob", 4).alias("prob"))


@query("tissue_model")
def tissue_model(spark, sf):
    """Probability of tissue per overview cell from a model trained on labelled regions."""
    s = tissue.merge_samples(cells.samples(spark, sf))
    m = learn.train_tissue_model(s, "cells")
    from patchframe.operators import raster

    feats = raster.cell_features(b.cells(spark, sf)).withColumn("features", F.array(*raster.FEATURES))
    return learn.predict_tissue(m, feats).select("slide", "x", "y", b.fixed("prob", 4).alias("prob"))


@query("merged_samples", f"""
WITH {b.patches_sql()}, g AS (SELECT DISTINCT slide, label FROM patches),
n AS (SELECT slide, label, dense_rank() OVER (ORDER BY slide, label) - 1 AS grp FROM g)
SELECT slide, patch_id, grp::INT AS "group" FROM patches JOIN n USING (slide, label)""")
def merged_samples(spark, sf):
    E = b.expression(spark, sf).select("slide", "patch_id", F.col("label").alias("group"))
    even = F.substring("slide", 2, 9).cast("int") % 2 == 0
    return tissue.merge_samples(E, E.filter(even)).select("slide", "patch_id", "group")


@query("training_summary", f"""
WITH {b.patches_sql()}
SELECT count(DISTINCT slide) AS slides, count(DISTINCT CASE WHEN label % 2 = 1 THEN slide || label END) AS tissue,
       count(DISTINCT CASE WHEN label % 2 = 0 THEN slide || label END) AS artefact, count(*) AS cells FROM patches""")
def training_summary(spark, sf):
    E = b.expression(spark, sf).select("slide", F.col("label").alias("group"), (F.col("label") % 2).alias("label"))
    return tissue.training_summary(E)


# --- what fits must satisfy, as facts SQL can state -------------------------------------

def _far_from_own(points, column: str, labels):
    """Points, clusters, points nearer to another cluster's mean than to their own, clusters larger than one before them."""
    d = points.join(labels, ["slide", "patch_id"])
    centres = d.select("label", F.posexplode(column).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("all"))
    distance = lambda c: F.aggregate(F.zip_with(F.col(column), c, lambda v, m: (v - m["m"]) * (v - m["m"])), F.lit(0.0), lambda a, x: a + x)
    near = F.array_min(F.transform("all", lambda k: distance(k["c"])))
    own = distance(F.filter("all", lambda k: k["label"] == F.col("label"))[0]["c"])
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wrong = sizes.alias("a").join(sizes.alias("b"), F.col("a.label") + 1 == F.col("b.label")).where("b.n > a.n").agg(F.count(F.lit(1)).alias("unordered"))
    return d.join(centres).agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("label").alias("clusters"), F.count_if(own > near + 1e-9).alias("misplaced")).join(wrong)


@query("kmeans_facts", "SELECT count(*) AS points, 8::BIGINT AS clusters, 0::BIGINT AS misplaced, 0::BIGINT AS unordered FROM embeddings")
def kmeans_facts(spark, sf):
    """Every point lies nearest to the mean of its own cluster; clusters are numbered by size."""
    emb = _emb(spark, sf)
    found, _, _ = learn.kmeans(emb, 8, column="vec")
    return _far_from_own(emb, "vec", found.select("slide", "patch_id", "label"))


@query("discover_facts", "SELECT count(*) AS points, 6::BIGINT AS clusters, 0::BIGINT AS misplaced, 0::BIGINT AS unordered FROM embeddings")
def discover_facts(spark, sf):
    """The same for classes found among components."""
    emb = _emb(spark, sf)
    found, _ = learn.discover(emb, 6)
    return _far_from_own(learn.pca_scores(emb).scores, "scores", found.select("slide", "patch_id", "label"))


@query("pca_facts", """
SELECT c.i::INT AS component, 0.0::DOUBLE AS mixed, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS share_off, true AS ordered
FROM range(6) c(i), (SELECT DISTINCT len(embedding) AS d FROM embeddings LIMIT 1) WHERE c.i < d""")
def pca_facts(spark, sf):
    """Components are centred, unmixed, ordered by variance, and their shares are variance over total variance."""
    c = learn.pca_scores(_emb(spark, sf), k=6)
    s = c.scores.select("slide", "patch_id", F.col("scores").alias("s"), F.col("vec").alias("v"))
    total = s.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("t")).agg(F.sum("t").alias("total"))
    at = s.select("slide", "patch_id", F.posexplode("s").alias("i", "x"))
    v = at.groupBy("i").agg(F.var_samp("x").alias("var"), F.avg("x").alias("mean"))
    pairs = at.join(at.select("slide", "patch_id", F.col("i").alias("j"), F.col("x").alias("y")), ["slide", "patch_id"]).where("i <> j")
    mixed = pairs.groupBy("i", "j").agg(F.abs(F.covar_samp("x", "y")).alias("c")).groupBy("i").agg(F.max("c").alias("mixed"))
    share = spark.createDataFrame([(i, e) for i, e in enumerate(c.explained)], "i int, share double")
    nxt = v.select((F.col("i") - 1).alias("i"), F.col("var").alias("after"))
    d = v.join(mixed, "i").join(share, "i").join(nxt, "i", "left").join(total)
    return d.select(
        F.col("i").alias("component"), b.fixed(F.abs(F.round("mixed", 9)), 6).alias("mixed"), b.fixed(F.abs(F.round("mean", 9)), 6).alias("mean"),
        b.fixed(F.abs(F.round(F.col("share") - F.col("var") / F.col("total"), 9)), 6).alias("share_off"),
        F.coalesce(F.col("after") <= F.col("var"), F.lit(True)).alias("ordered"))


@query("communities_facts", """
SELECT count(*) AS nodes, true AS beats_labels, true AS numbered_by_size, true AS connected, 0::BIGINT AS better_moves FROM embeddings""")
def communities_facts(spark, sf):
    """What holds for the groups: at least the modularity of the given labels, group 0 the largest, every group
    connected, and no node whose move to another group, or out on its own, would raise modularity."""
    edges = components.cut_lineage(graph.knn_graph(points(spark, sf), 15))
    found = components.cut_lineage(graph.communities(edges))
    given = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    mine = graph.modularity(edges, found).select(F.col("modularity").alias("mine"))
    theirs = graph.modularity(edges, given).select(F.col("modularity").alias("theirs"))
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("groups"), (F.max("n") == F.max(F.when(F.col("label") == 0, F.col("n")))).alias("numbered_by_size"))
    of = lambda c: found.select(F.col("id").alias(c), F.col("label").alias("l" + c))
    both = edges.join(of("src"), "src").join(of("dst"), "dst")
    roots = components.linked_roots(both.where("lsrc = ldst").select(F.lit("").alias("slide"), F.col("src").alias("a"), F.col("dst").alias("b")))
    parts = found.join(roots.select(F.col("v").alias("id"), "root"), "id", "left").agg(F.count_distinct(F.coalesce("root", "id")).alias("parts"))
    # Gain of every node in every group it has a link to, and alone, against where it is.
    ends = both.select(F.col("src").alias("id"), F.col("lsrc").alias("own"), F.col("ldst").alias("label"), "w").unionByName(
        both.select(F.col("dst").alias("id"), F.col("ldst").alias("own"), F.col("lsrc").alias("label"), "w"))
    k = ends.groupBy("id", "own").agg(F.sum("w").alias("s"))
    total, m2 = k.groupBy(F.col("own").alias("label")).agg(F.sum("s").alias("tot")), k.agg(F.sum("s").alias("m2"))
    links = ends.groupBy("id", "label").agg(F.sum("w").alias("k")).unionByName(k.select("id", F.col("own").alias("label"), F.lit(0.0).alias("k")))
    links = links.groupBy("id", "label").agg(F.sum("k").alias("k")).join(k, "id").join(total, "label").join(m2)
    gain = F.col("k") - F.col("s") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("s")).otherwise(0.0)) / F.col("m2")
    best = links.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("own"), gain)).alias("now"), F.greatest(F.lit(0.0), F.max(gain)).alias("top"))
    better = best.agg(F.count_if(F.col("top") > F.col("now") + 1e-6).alias("better_moves"))
    return sizes.join(mine).join(theirs).join(parts).join(better).select(
        "nodes", (F.col("mine") >= F.col("theirs")).alias("beats_labels"), "numbered_by_size", (F.col("parts") == F.col("groups")).alias("connected"), "better_moves")


def _fixed_head(d: int = 64) -> learn.LinearModel:
    """A head whose weights follow a rule, so SQL can apply it too."""
    weights = [[((c + 1) * (i % 5) - 4) / 8 for i in range(d)] for c in range(3)]
    return learn.LinearModel("head", ["a", "b", "c"], weights, [0.0, 0.25, 0.5], [0.125] * d, [0.5] * d, {})


@query("head_fixed", f"""
WITH {b.LONG_SQL},
l AS (SELECT slide, patch_id, c.i::INT AS class, c.i / 4.0 + sum((value - 0.125) / 0.5 * (((c.i + 1) * (gene_idx % 5) - 4) / 8.0)) AS z
      FROM long, range(3) c(i) GROUP BY slide, patch_id, c.i)
SELECT slide, patch_id, class, {r('exp(z) / sum(exp(z)) OVER (PARTITION BY slide, patch_id)')} AS prob FROM l""")
def head_fixed(spark, sf):
    """A head with known weights: softmax of its linear forms."""
    E = b.expression(spark, sf).withColumnRenamed("values", "features")
    return learn.predict_and_blend(_fixed_head(), E).select("slide", "patch_id", F.col("class").cast("int").alias("class"), b.fixed("prob").alias("prob"))


@query("tissue_fixed", f"""
WITH {b.LONG_SQL}
SELECT slide, patch_id, {r('1 / (1 + exp(-(0.5 + sum((value - 0.125) / 0.5 * ((gene_idx % 5 - 2) / 8.0)))))')} AS prob
FROM long GROUP BY slide, patch_id""")
def tissue_fixed(spark, sf):
    """A tissue model with known weights: sigmoid of its linear form."""
    E = b.expression(spark, sf).withColumnRenamed("values", "features")
    m = learn.LinearModel("tissue", ["artefact", "tissue"], [[(i % 5 - 2) / 8 for i in range(64)]], [0.5], [0.125] * 64, [0.5] * 64, {})
    return learn.predict_tissue(m, E).select("slide", "patch_id", b.fixed("prob").alias("prob"))


@query("head_gradient", """
SELECT c.i::INT AS class, 0.0::DOUBLE AS steepest FROM range(3) c(i)""")
def head_gradient(spark, sf):
    """At the fit the objective is flat: per class, the steepest derivative over all weights is zero.

    The objective is the class-balanced logistic loss plus the ridge on scaled weights;
    every label is fitted (``refit``), so the sums run over all of them.
    """
    L = labelled(spark, sf)
    m = learn.train_head(L, ["a", "b", "c"], 300.0, refit=True)
    n = sum(m.samples.values())
    weight = F.element_at(F.array(*[F.lit(n / (3 * m.samples[c])) for c in m.classes]), F.col("label") + 1)
    scored = learn.predict_head(m, L).withColumn("w", weight)
    z = scored.select("label", "w", "probs", F.posexplode(F.zip_with(
        "features", F.array(*[F.struct(F.lit(a).alias("m"), F.lit(s).alias("s")) for a, s in zip(m.mean, m.scale)]), lambda v, k: (v - k["m"]) / k["s"])).alias("i", "x"))
    z = z.select("label", "w", "i", "x", F.posexplode("probs").alias("class", "p"))
    g = z.groupBy("class", "i").agg((F.sum(F.col("w") * (F.col("p") - (F.col("label") == F.col("class")).cast("int")) * F.col("x")) / n).alias("g"))
    ridge = spark.createDataFrame([(c, i, float(v)) for c, row in enumerate(m.weights) for i, v in enumerate(row)], "class int, i int, v double")
    l2 = learn.l2_for(len(m.mean), n)
    return g.join(ridge, ["class", "i"]).groupBy("class").agg(
        b.fixed(F.abs(F.round(F.max(F.abs(F.col("g") + F.lit(l2) * F.col("v"))), 3)), 3).alias("steepest")).select(F.col("class").cast("int").alias("class"), "steepest")
