"""Soft-membership mixing: rates at which slides' texts meet target class totals, in built-in functions only.

A classifier made of labelled tables gives every row class posteriors; projected
gradient descent on least squares finds the nonnegative rates.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

log = logging.getLogger(__name__)

BUCKETS = 1024  # hashed words
STEPS = 16  # levels of each quantised score


def _words(text: Column) -> Column:
    """Hash bucket of every word."""
    return F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def _scores(words: Column, tables: list[list[float]]) -> list[Column]:
    """Mean weight of the words under each table."""
    looked = [F.array(*map(F.lit, t)) for t in tables]
    total = F.aggregate(
        words, F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(len(tables))]),
        lambda a, w: F.struct(*[(a[f"s{i}"] + F.get(t, w)).alias(f"s{i}") for i, t in enumerate(looked)]),
    )
    # Halfway between sum and mean: a few telling words of a long text still show.
    return [total[f"s{i}"] / F.sqrt(F.size(words)) for i in range(len(tables))]


def word_tables(labelled: DataFrame, classes: list[str], text: str, cls: str) -> list[list[float]]:
    """Per class the log ratio of each word bucket's share within it to its share in all others."""
    own = labelled.select(F.col(cls).alias("c"), F.explode(_words(F.col(text))).alias("w")).groupBy("c", "w").agg(F.count(F.lit(1)).alias("n"))
    n = {(r.c, r.w): r.n for r in own.collect()}  # classes x BUCKETS at most
    sums = {c: sum(v for (k, _), v in n.items() if k == c) for c in classes}
    every, tables = sum(sums.values()), []
    for c in classes:
        row = []
        for w in range(BUCKETS):
            a = n.get((c, w), 0)
            rest = sum(n.get((k, w), 0) for k in classes) - a
            row.append(round(math.log((a + 1) / (sums[c] + BUCKETS)) - math.log((rest + 1) / (every - sums[c] + BUCKETS)), 4))
        tables.append(row)
    return tables


def fit_rates(cells: DataFrame, classes: list[str], goal: list[float], least: float = 0.0, tolerance: float = 1e-4) -> DataFrame:
    """Rates of rows with ``size`` and ``post`` (an array, one posterior per class): columns ``rate``, ``distance`` and ``nearest`` more.

    Minimises half the squared distance between the expected class totals
    ``sum(rate * size * post)`` and ``goal`` (both as shares of all size) over rates of
    at least ``least``: projected gradient steps from rate one, as long as the steepest
    direction of the totals' Gram matrix allows, with momentum that restarts when the
    distance grows.  A round is one aggregation of as many sums as there are classes.

    It ends when every total is within ``tolerance`` of its goal, when ``distance`` is
    proven to be within ``tolerance`` of the smallest there is, or after ten rounds in a row
    in which no total moved by a tenth of that.  The number of rounds has no limit.

    ``distance`` is what is left: the root of the sum of squares of total - goal.  No rates
    get below ``nearest``, which the projected gradient proves: rates above ``least`` can come
    down by the totals they add, and the others can rise by no more size than totals nearer
    to the goal have, so the slopes bound what the distance can still fall.  A gap between
    the two means that the rounds ended before the nearest totals, or that the bound is wide.
    Without any size rates are one and both are null.
    """
    k = len(classes)
    post = lambda i: F.get("post", F.lit(i))
    along = lambda way: sum((post(i) * F.lit(g) for i, g in enumerate(way)), F.lit(0.0))
    total = cells.agg(F.sum("size")).first()[0] or 0
    if not total:
        return cells.select("*", F.lit(1.0).alias("rate"), *[F.lit(None).cast("double").alias(c) for c in ("distance", "nearest")])
    share = F.col("size") / total
    sums = cells.where("size > 0").agg(*[F.sum(share * post(i) * post(j)) for i in range(k) for j in range(k)], *[F.sum(share * post(i)) for i in range(k)]).first()
    steepest = max(sum(abs(sums[i * k + j]) for j in range(k)) for i in range(k))  # at least the largest eigenvalue
    floor = [least * x for x in sums[k * k:]]  # totals at the least rates
    state = cells.withColumn("rate", F.lit(1.0)).withColumn("lead", F.lit(1.0))
    t, before, owned, far, n, idle, nearest = 1.0, [0.0] * k, None, math.inf, 0, 0, 0.0
    while True:
        # ``low`` is the steepest descent left at the totals of the round before.
        now = state.where("size > 0").agg(*[F.sum(share * F.col(x) * post(i)) for x in ("lead", "rate") for i in range(k)], F.min(along(before)).alias("low")).first()
        lead, at = list(now[:k]), list(now[k:2 * k])
        off = [a - g for a, g in zip(at, goal)]
        distance = math.sqrt(sum(x * x for x in off))
        if n:
            down = sum(b * (b + g - f) for b, g, f in zip(before, goal, floor))
            # Totals no farther from the goal than those had at most this size above the least rates.
            room = max(0.0, sum(goal) + math.sqrt(k) * far - sum(floor))
            gap = down + room * max(0.0, -now["low"])
            nearest = max(nearest, math.sqrt(max(0.0, far**2 - 2 * gap)))
            idle = idle + 1 if max(abs(x - b) for x, b in zip(off, before)) < tolerance / 10 else 0
        if max(map(abs, off)) < tolerance or distance - nearest <= tolerance or idle >= 10:
            break
        if distance > far:
            state, lead, t = state.withColumn("lead", F.col("rate")), at, 1.0
        before, far = off, distance
        slope = along([(a - g) / steepest for a, g in zip(lead, goal)])
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        state = state.withColumn("next", F.greatest(F.lit(least), F.col("lead") - slope))
        state = state.withColumn("lead", F.col("next") + F.lit((t - 1) / t_next) * (F.col("next") - F.col("rate"))).withColumn("rate", F.col("next")).drop("next")
        t, n = t_next, n + 1
        if n % 8 == 0:
            new = stage(state, "rates")
            if owned is not None:
                drop_stage(owned)
            state = owned = new
    log.info("rates: %d rounds, class totals %.6f from their targets, at least %.6f for any rates", n, distance, nearest)
    return state.select(*cells.columns, "rate", F.lit(distance).alias("distance"), F.lit(min(nearest, distance)).alias("nearest"))


def mix_to_targets(annotations: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "id", text: str = "name",
                   cls: str = "class_id", least: float = 0.0, budget: float = 1.0, fit_rows: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """Rate of every annotation so that expected class totals meet ``targets``: ``id, keep…, size, post_<class>…, rate, distance, nearest``.

    annotations   id and free text (``name``)
    labelled      id and class of some of them, one row per id; classes outside ``targets`` are left out
    targets       class -> share of the total size; shares are scaled to add up to one
    budget        total size asked for, as a multiple of the size there is
    size          words of the text
    least         smallest rate allowed (1: every row stays)
    distance      how far the expected totals end from their targets, as a share of all size; ``nearest``: no rates come closer (see :func:`fit_rates`)

    The classifier is fitted on a bounded sample: the ``fit_rows`` labelled rows that come
    first in hash order, half for the word tables and half for the posterior table, which
    has STEPS quantised scores per class as its key.  So rows share posteriors and rates by
    cell, and there are at most STEPS ^ classes cells, whatever the number of rows.  All
    rows' sizes enter the fit and all rows get a rate.

    A null text is empty: one empty word to the classifier, and of size 0.  Repeated rows
    and null ids keep their rows.  With no labels posteriors are even and rates one wherever the targets allow it.
    An empty table gives an empty result; other columns do not matter.
    """
    keep = keep or []
    classes = sorted(targets)
    share = [budget * targets[c] / sum(targets.values()) for c in classes]
    A = annotations.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    L = labelled.select(F.col(id).alias("_id"), F.col(cls).alias("_c")).where(F.col("_c").isin(classes) & F.col("_id").isNotNull())
    L = L.orderBy(F.xxhash64("_id")).limit(fit_rows)
    T = A.select("_id", "_t").join(L, "_id").withColumn("half", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)))
    tables = word_tables(T.where("half = 0"), classes, "_t", "_c")

    def cell(text: Column) -> Column:
        level = [F.least(F.greatest(F.floor(s * 2 + STEPS // 2), F.lit(0)), F.lit(STEPS - 1)) for s in _scores(_words(text), tables)]
        return sum((x * F.lit(STEPS**i) for i, x in enumerate(level)), F.lit(0)).cast("long")

    seen = T.where("half = 1").select("_c", cell(F.col("_t")).alias("cell")).groupBy("cell").agg(
        *[F.count_if(F.col("_c") == c).alias(f"n{i}") for i, c in enumerate(classes)])
    seen = stage(seen, "cells")
    sums = seen.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(classes))]).first()
    prior = [(s + 1) / (sum(sums) + len(classes)) for s in sums]
    size = F.when(F.trim("_t") == "", 0).otherwise(F.size(F.split(F.trim("_t"), r"\s+"))).cast("long")
    S = stage(A.select("_id", *[f"_k{i}" for i in range(len(keep))], size.alias("size"), cell(F.col("_t")).alias("cell")), "scored")
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0)) + F.lit(4 * p) for i, p in enumerate(prior)]
    cells = S.groupBy("cell").agg(F.sum("size").alias("size")).join(F.broadcast(seen), "cell", "left").select("cell", "size", F.array(*[x / sum(n[1:], n[0]) for x in n]).alias("post"))
    rates = fit_rates(stage(cells, "posts"), classes, share, least)
    out = S.join(F.broadcast(rates.select("cell", "post", "rate", "distance", "nearest")), "cell")
    return out.select(
        F.col("_id").alias(id), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size",
        *[F.get("post", F.lit(i)).alias(f"post_{c}") for i, c in enumerate(classes)], "rate", "distance", "nearest",
    )
