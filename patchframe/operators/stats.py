"""Rank statistics without a window that grows with the data.

Ranks are computed from value histograms.  A histogram is a hash aggregation with a
map-side combine, so identical values meet before the shuffle.  Distinct values are
then ordered in two bounded steps: within a coarse value bucket, and over the
buckets of a group.  No task ever sorts a whole group, so one slide may hold most
of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchframe.functions.scalar import two_sided_p, value_bucket


def _cols(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def group_histogram(df: DataFrame, by, value: str, inside: Column) -> DataFrame:
    """``by…, v, n_in, n_out``: how often each value occurs in and out of a group."""
    return (
        df.groupBy(*_cols(by), (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
        .agg(
            F.sum(inside.cast("bigint")).alias("n_in"),
            F.sum(F.lit(1) - inside.cast("bigint")).alias("n_out"),
        )
    )


def mann_whitney(hist: DataFrame, by, bounded: bool = False) -> DataFrame:
    """Mann-Whitney U per group from ``(by…, v, n_in, n_out)``.

    ``bounded`` says that a group cannot have many distinct values (byte codes,
    half floats); the histogram is then swept in one window instead of two levels.
    ``u`` counts pairs with the inside value above, ties half.  Doubled counts are
    kept in integers, so the result does not depend on the order of summation.
    """
    by = _cols(by)
    sums = [
        F.sum("n_in").alias("n_in"),
        F.sum("n_out").alias("n_out"),
        F.sum(F.col("v") * F.col("n_in")).alias("sum_in"),
        F.sum(F.col("v") * F.col("n_out")).alias("sum_out"),
    ]
    pairs = F.col("n_in") * (F.coalesce(F.col("below"), F.lit(0)) * 2 + F.col("n_out"))
    if bounded:
        w = _before(W.partitionBy(*by).orderBy("v"))
        swept = hist.withColumn("below", F.sum("n_out").over(w))
        out = swept.groupBy(*by).agg(F.sum(pairs).alias("u2"), *sums)
    else:
        h = hist.withColumn("bucket", value_bucket("v"))
        inner = _before(W.partitionBy(*by, "bucket").orderBy("v"))
        b = (
            h.withColumn("below", F.sum("n_out").over(inner))
            .groupBy(*by, "bucket")
            .agg(F.sum(pairs).alias("u2"), *sums)
        )
        outer = _before(W.partitionBy(*by).orderBy("bucket"))
        shift = F.col("n_in") * 2 * F.coalesce(F.col("below"), F.lit(0))
        out = (
            b.withColumn("below", F.sum("n_out").over(outer))
            .groupBy(*by)
            .agg(
                F.sum(F.col("u2") + shift).alias("u2"),
                *[F.sum(c).alias(c) for c in ("n_in", "n_out", "sum_in", "sum_out")],
            )
        )
    return out.withColumn("u", F.col("u2") / 2).drop("u2")


def mann_whitney_rank(long: DataFrame, by, value: str, inside: Column) -> DataFrame:
    """The same U straight from mid-ranks: the definition, for cross-checks and for
    groups known to be small.  Sorts each group whole."""
    by = _cols(by)
    v = F.col(value).cast("double") + F.lit(0.0)
    order = W.partitionBy(*by).orderBy("__v")
    ties = W.partitionBy(*by, "__v")
    ranked = long.select(*by, v.alias("__v"), inside.cast("bigint").alias("__in")).withColumn(
        "__rank", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2
    )
    n_in, n_out = F.sum("__in"), F.sum(1 - F.col("__in"))
    return ranked.groupBy(*by).agg(
        (F.sum(F.when(F.col("__in") == 1, F.col("__rank"))) - n_in * (n_in + 1) / 2).alias("u"),
        n_in.alias("n_in"),
        n_out.alias("n_out"),
        F.sum(F.when(F.col("__in") == 1, F.col("__v")).otherwise(0.0)).alias("sum_in"),
        F.sum(F.when(F.col("__in") == 0, F.col("__v")).otherwise(0.0)).alias("sum_out"),
    )


def mw_p_value(u, n_in, n_out) -> Column:
    """Two-sided normal p.  No tie and no continuity correction."""
    u, n_in, n_out = (F.col(c) if isinstance(c, str) else c for c in (u, n_in, n_out))
    a, b = n_in.cast("double"), n_out.cast("double")
    var = a * b / 12 * (a + b + 1)
    z = (u - a * b / 2) / F.sqrt(F.when(var > 0, var))
    return F.when(var > 0, two_sided_p(z)).otherwise(F.lit(1.0))


def compared(u: DataFrame) -> DataFrame:
    """Means, effect size and p from the sums of :func:`mann_whitney`."""
    n = F.col("n_in") + F.col("n_out")
    return (
        u.withColumn("mean", (F.col("sum_in") + F.col("sum_out")) / n)
        .withColumn("mean_in", F.col("sum_in") / F.when(F.col("n_in") > 0, F.col("n_in")))
        .withColumn("mean_out", F.col("sum_out") / F.when(F.col("n_out") > 0, F.col("n_out")))
        .withColumn("diff", F.col("mean_in") - F.col("mean_out"))
        .withColumn(
            "auc",
            F.col("u") / F.when(F.col("n_in") * F.col("n_out") > 0, F.col("n_in") * F.col("n_out")),
        )
        .withColumn("p", mw_p_value("u", "n_in", "n_out"))
    )


def benjamini_hochberg(df: DataFrame, by, p: str = "p", q: str = "q", tie: str | None = None) -> DataFrame:
    """Adjusted p per test family.  A family is one row per test, so its size is the
    number of genes or modules, not of patches."""
    by = _cols(by)
    order = [F.col(p)] + ([F.col(tie)] if tie else [])
    asc = W.partitionBy(*by).orderBy(*order)
    ahead = asc.rowsBetween(0, W.unboundedFollowing)
    return (
        df.withColumn("__k", F.row_number().over(asc))
        .withColumn("__m", F.count(F.lit(1)).over(W.partitionBy(*by)))
        .withColumn("__a", F.col(p) * F.col("__m") / F.col("__k"))
        .withColumn(q, F.least(F.lit(1.0), F.min("__a").over(ahead)))
        .drop("__k", "__m", "__a")
    )


def value_counts(df: DataFrame, by, value: str) -> DataFrame:
    return df.groupBy(*_cols(by), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )


def nearest_rank(df: DataFrame, by, value: str, percentiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles per group, one column per entry.

    The value at position ``round_half_up(p/100*(n-1))``; nothing is interpolated.
    Bucket totals find the bucket that holds each position, then only that bucket
    is ordered.
    """
    by = _cols(by)
    counts = value_counts(df, by, value).withColumn("bucket", value_bucket("v"))
    per_bucket = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"))
    over = W.partitionBy(*by).orderBy("bucket")
    placed = (
        per_bucket.withColumn("hi", F.sum("bn").over(over))
        .withColumn("lo", F.col("hi") - F.col("bn"))
        .withColumn("total", F.sum("bn").over(W.partitionBy(*by)))
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("pct")) for k, v in percentiles.items()])
    )
    target = F.least(
        F.col("total") - 1,
        F.greatest(F.lit(0), F.floor(F.col("w.pct") / 100 * (F.col("total") - 1) + 0.5)),
    )
    hits = (
        placed.withColumn("w", wanted)
        .withColumn("at", target)
        .filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .select(*by, "bucket", F.col("w.k").alias("k"), (F.col("at") - F.col("lo")).alias("at"))
    )
    inner = W.partitionBy(*by, "bucket", "k").orderBy("v")
    return (
        counts.join(hits, [*by, "bucket"])
        .withColumn("upto", F.sum("n").over(inner))
        .filter(F.col("upto") > F.col("at"))
        .groupBy(*by)
        .agg(*[F.min(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in percentiles])
    )


def percentile_threshold(field: DataFrame, pct: float, by="slide", value: str = "value") -> DataFrame:
    return nearest_rank(field, by, value, {"threshold": pct})


def robust_range(field: DataFrame, low: float = 2, high: float = 98, by="slide", value: str = "value") -> DataFrame:
    """Display range between two percentiles; a flat field is widened by half a unit."""
    r = nearest_rank(field, by, value, {"lo": low, "hi": high})
    flat = F.col("hi") - F.col("lo") <= 1e-9
    return r.select(
        *_cols(by),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("lo") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def row_numbers(df: DataFrame, by, bucket: Column, order: list, name: str = "index") -> DataFrame:
    """0-based position per group, in two bounded steps.

    ``bucket`` must not decrease along ``order``; each (group, bucket) is ordered
    on its own and shifted by the rows of the buckets before it.  There may be nearly as
    many buckets as rows, so they are not broadcast.
    """
    by = _cols(by)
    d = df.withColumn("__b", bucket)
    sizes = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.withColumn(
        "__start",
        F.coalesce(F.sum("__n").over(_before(W.partitionBy(*by).orderBy("__b"))), F.lit(0)),
    ).drop("__n")
    return (
        d.withColumn("__i", F.row_number().over(W.partitionBy(*by, "__b").orderBy(*order)) - 1)
        .join(start.hint("merge"), [*by, "__b"])
        .withColumn(name, (F.col("__i") + F.col("__start")).cast("bigint"))
        .drop("__b", "__i", "__start")
    )


def positions(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """0-based position of every row along ``order``, over the whole table.

    Ranges of ``order`` are sorted apart and shifted by the rows of the ranges before
    them; only one count per range is looked at together.  Ties keep one of their orders.
    """
    from .components import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select("__p", F.coalesce(F.sum("__n").over(_before(W.orderBy("__p"))), F.lit(0)).alias("__s"))
    at = (F.col("__m") - F.shiftleft(F.col("__p"), 33) + F.col("__s")).cast("bigint")
    return ranged.withColumn("__p", part).join(start, "__p").withColumn(name, at).drop("__m", "__p", "__s")
