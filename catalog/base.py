"""How the shared tables stand in for a slide's data.

embeddings  an expression map: vec = patch, position = gene, on a 25-wide lattice of
            100-pixel patches, 250 patches to a slide
lineitem    overview cells: order = cell on a 64 x 64 slide, colour from its lines
customer,   points in slide pixels, derived from the key
supplier
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.operators import raster

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- expression map -------------------------------------------------------------

def expression(spark, sf, step: int = 100) -> DataFrame:
    """Expression map of the embeddings.  ``inside`` is label 0."""
    i = F.col("vec_id") % 250
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("s"), F.floor(F.col("vec_id") / 250).cast("string")).alias("slide"),
        i.alias("patch_id"),
        (i % 25 * step).alias("x"),
        (F.floor(i / 25) * step).alias("y"),
        F.lit(100).alias("side"),
        F.col("embedding").alias("values"),
        F.col("label").cast("int").alias("label"),
        (F.col("label") == 0).alias("inside"),
    )


def genes(E: DataFrame) -> DataFrame:
    """Gene table: ``g<position>`` for each position of the slide's arrays."""
    width = E.groupBy("slide").agg(F.max(F.size("values")).alias("w"))
    return width.select(
        "slide", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("gene_idx")
    ).select(
        "slide", "gene_idx", F.concat(F.lit("g"), F.col("gene_idx").cast("string")).alias("gene"),
        F.lit(None).cast("float").alias("scale"), F.lit(None).cast("float").alias("zero"),
    )


def patches_sql(step: int = 100) -> str:
    return f"""
patches AS (
  SELECT 's' || (vec_id // 250) AS slide, vec_id % 250 AS patch_id,
         (vec_id % 250) % 25 * {step} AS x, (vec_id % 250) // 25 * {step} AS y, 100 AS side,
         label, embedding
  FROM embeddings)"""


LONG_SQL = patches_sql() + """,
long AS (
  SELECT slide, patch_id, x, y, side, label, (g.i - 1)::INT AS gene_idx, embedding[g.i]::DOUBLE AS value
  FROM patches, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) g)"""


def sf_sql(z: str) -> str:
    """Upper normal tail of a non-negative ``z`` in SQL, the same approximation."""
    x = f"(({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5 * {x}))"
    poly = "0.17087277::DOUBLE"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806",
              "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
        poly = f"({poly} * {t} + ({c}::DOUBLE))"
    return f"({t} * exp({poly} - {x} * {x}) / 2)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def mw_sql(source: str, by: str) -> str:
    """CTEs from ``source(by…, value, inside)`` to ``tested`` with auc and p, by mid-ranks."""
    return f"""
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value)
            + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0::DOUBLE AS rk
  FROM {source}),
u AS (
  SELECT {by}, sum(CASE WHEN inside THEN 1 ELSE 0 END)::DOUBLE AS n_in,
         sum(CASE WHEN inside THEN 0 ELSE 1 END)::DOUBLE AS n_out,
         sum(CASE WHEN inside THEN rk END) AS rin,
         avg(CASE WHEN inside THEN value END) AS mean_in,
         avg(CASE WHEN inside THEN NULL ELSE value END) AS mean_out, avg(value) AS mean
  FROM ranked GROUP BY {by}),
z AS (
  SELECT *, rin - n_in * (n_in + 1) / 2 AS u0, n_in * n_out / 12 * (n_in + n_out + 1) AS var FROM u),
tested AS (
  SELECT {by}, mean, mean_in, mean_out, mean_in - mean_out AS diff, u0 / (n_in * n_out) AS auc,
         least(1.0, 2 * {sf_sql('abs(u0 - n_in * n_out / 2) / sqrt(var)')}) AS p,
         n_in::BIGINT AS n_in, n_out::BIGINT AS n_out
  FROM z)"""


def bh_sql(source: str, family: str, tie: str) -> str:
    return f"""
stepped AS (
  SELECT *, p * count(*) OVER (PARTITION BY {family})
            / row_number() OVER (PARTITION BY {family} ORDER BY p, {tie}) AS a
  FROM {source}),
adjusted AS (
  SELECT *, least(1.0, min(a) OVER (PARTITION BY {family} ORDER BY p, {tie}
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
  FROM stepped)"""


def fixed(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(c, digits) for c in cols})


def values_sql(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r_) + ")" for r_ in rows) + ")"


# --- overview cells -------------------------------------------------------------

def cells(spark, sf) -> DataFrame:
    """Overview cells of the orders: 64 x 64 to a slide, white where a slide ends early.

    Blocks of 8 x 8 whose summed quantity is a multiple of three are stained, the
    rest is pale; single cells vary with their own lines.
    """
    k = F.col("o_orderkey")
    line = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
    )
    d = (
        table(spark, sf, "orders").select("o_orderkey")
        .join(line, k == F.col("l_orderkey"), "left")
        .select(
            F.concat(F.lit("c"), F.floor(k / 4096).cast("string")).alias("slide"),
            (k % 64).cast("int").alias("x"),
            (F.floor(k / 64) % 64).cast("int").alias("y"),
            F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("disc", F.lit(0)).alias("disc"),
        )
    )
    block = W.partitionBy("slide", F.floor(F.col("x") / 8), F.floor(F.col("y") / 8))
    d = d.withColumn("stained", F.sum("qty").over(block) % 3 == 0)
    shade = F.col("qty") % 24 + F.col("disc") % 7
    seen = d.select(
        "slide", "x", "y",
        F.when(F.col("stained"), 200 - shade).otherwise(240 - F.col("qty") % 4).cast("int").alias("r"),
        F.when(F.col("stained"), 130 - shade).otherwise(240 - F.col("disc") % 3).cast("int").alias("g"),
        F.when(F.col("stained"), 180 - shade).otherwise(241 - F.col("qty") % 5).cast("int").alias("b"),
    )
    slide = F.concat(F.lit("c"), F.floor(k / 4096).cast("string")).alias("slide")
    extent = table(spark, sf, "orders").select(slide).distinct().withColumns({"w": F.lit(64), "h": F.lit(64)})
    return raster.fill_missing(seen, extent)


CELLS_SQL = """
line AS (
  SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS qty,
         sum(round(l_discount * 100)::BIGINT)::BIGINT AS disc
  FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT 'c' || (o_orderkey // 4096) AS slide, (o_orderkey % 64)::INT AS x, (o_orderkey // 64 % 64)::INT AS y,
         coalesce(qty, 0) AS qty, coalesce(disc, 0) AS disc
  FROM orders LEFT JOIN line ON l_orderkey = o_orderkey),
block AS (
  SELECT slide, x // 8 AS bi, y // 8 AS bj, sum(qty)::BIGINT % 3 = 0 AS stained FROM raw GROUP BY ALL),
seen AS (
  SELECT raw.slide, x, y,
         (CASE WHEN stained THEN 200 - (qty % 24 + disc % 7) ELSE 240 - qty % 4 END)::INT AS r,
         (CASE WHEN stained THEN 130 - (qty % 24 + disc % 7) ELSE 240 - disc % 3 END)::INT AS g,
         (CASE WHEN stained THEN 180 - (qty % 24 + disc % 7) ELSE 241 - qty % 5 END)::INT AS b
  FROM raw JOIN block ON raw.slide = block.slide AND x // 8 = bi AND y // 8 = bj),
cells AS (
  SELECT f.slide, f.x, f.y, coalesce(r, 255)::INT AS r, coalesce(g, 255)::INT AS g, coalesce(b, 255)::INT AS b
  FROM (SELECT s.slide, x.i::INT AS x, y.i::INT AS y FROM (SELECT DISTINCT slide FROM seen) s, range(64) x(i), range(64) y(i)) f
  LEFT JOIN seen USING (slide, x, y))"""
