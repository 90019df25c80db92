"""Balanced label propagation: linked slides share a shard, shards stay even."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stage, stage

BUCKET = 50_000  # rows that one window task orders


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, total: int, name: str = "before") -> DataFrame:
    """``name``: sum of ``value`` over the rows of the same ``keys`` that come earlier.

    The order is by hash bucket first, then ``order``; buckets hold about ``BUCKET``
    rows each, so neither a large key nor no key at all is one task.
    """
    buckets = max(1, math.ceil(total / BUCKET))
    df = df.withColumn("_v", value).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    part = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(part), F.lit(0))).drop("_s")
    within = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = inner.alias("l").join(offsets.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]])
    return joined.select("l.*", (F.col("_w") + F.col("_o")).alias(name)).drop("_v", "_b", "_w")


def _intervals(values: list[tuple[int, int]]) -> Column:
    """Literal array of ``lo, hi, shard`` for shards and their room, end to end."""
    out, at = [], 0
    for shard, room in values:
        if room > 0:
            out.append(F.struct(F.lit(at).cast("long").alias("lo"), F.lit(at + room).cast("long").alias("hi"), F.lit(shard).alias("shard")))
            at += room
    return F.array(*out) if out else F.array().cast("array<struct<lo:bigint,hi:bigint,shard:int>>")


def _pick(intervals: Column, rank: Column) -> Column:
    return F.filter(intervals, lambda x: (x["lo"] <= rank) & (rank < x["hi"]))[0]


def place_linked(slides: DataFrame, n_shards: int = 40, id: str = "slide", link: str = "twin", keep: list[str] | None = None) -> DataFrame:
    """Put slides into ``n_shards`` shards whose row counts differ by one at most: ``id, keep…, shard, slot``.

    slides   one row per slide (or document): its id and ``link``; rows with the same
             link are linked to each other, a null link to nothing
    keep     columns carried along
    slot     place within the shard, gapless from 0

    Every row starts in the shard its hash says.  In each round the part of a link group
    that lies in another shard than the group's largest part asks to move there; requests
    are granted in hash order up to what the shard's quota leaves for linked rows, the last
    in part.  Groups larger than a shard go on to their next largest part.  It stops when
    no request is granted; each grant leaves fewer linked pairs cut, as no part moves to a
    smaller one, so the rounds end.  Unlinked rows then fill every shard up to
    its quota.  Work in the rounds is on counts per (group, shard), with a group's rows
    never together; ranks come from bounded buckets (:func:`running`), so a link that a
    third of all rows share is as spread as any.

    Null ids and repeated rows each keep their row and get a slot; an empty table gives an
    empty result.  Other columns do not matter.
    """
    keep = keep or []
    S = slides.select(F.col(id).alias("_id"), F.col(link).alias("_g"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kept = [f"_k{i}" for i in range(len(keep))]
    S = S.withColumn("_h", F.xxhash64("_id", *kept)).withColumn("_s", F.pmod("_h", F.lit(n_shards)).cast("int"))
    S = stage(S, "slides")
    n = S.count()
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    quotas = F.array(*map(F.lit, quota))

    start = S.where("_g IS NOT NULL").groupBy("_g", F.col("_s").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    whole = start.groupBy("_g").agg(F.sum("n").alias("all")).where("`all` > 1")
    state = stage(start.join(whole.select("_g"), "_g", "left_semi"), "parts")
    # Rows look their group up by group and first shard, so a large group's rows stay spread.
    pairs = state.select("_g", F.col("s").alias("_s"))
    first = state

    while True:
        load = {r.s: r.n for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        room = F.array(*[F.lit(max(0, quota[s] - load.get(s, 0))).cast("long") for s in range(n_shards)])
        # A group's goal is its largest part in a shard with room left.
        best = state.groupBy("_g").agg(F.max(F.when(F.get(room, F.col("s")) > 0, F.struct("n", (-F.col("s")).alias("s")))).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1 AND m IS NOT NULL")
        asks = state.join(best.select("_g", (-F.col("m.s")).alias("t"), F.col("m.n").alias("top")), "_g").where("s <> t AND n <= top")
        asks = stage(asks.select("_g", "s", "t", "n"), "asks")
        total = asks.count()
        if not total:
            drop_stage(asks)
            break
        granted = running(asks, ["t"], [F.col("_g"), F.col("s")], F.col("n"), total)
        granted = granted.withColumn("m", F.least(F.col("n"), F.get(room, F.col("t")) - F.col("before"))).where("m > 0")
        granted = stage(granted.select("_g", "s", "t", "m"), "granted")
        moved = state.unionByName(granted.select("_g", "s", (-F.col("m")).alias("n"))).unionByName(granted.select("_g", F.col("t").alias("s"), F.col("m").alias("n")))
        new = stage(moved.groupBy("_g", "s").agg(F.sum("n").alias("n")).where("n > 0"), "parts")
        done = granted.isEmpty()
        for old in (asks, granted, state if state is not first else None):
            if old is not None:
                drop_stage(old)
        state = new
        if done:
            break

    # Parts over a shard's quota (possible when nearly all rows are linked) go where room is left.
    load = {r.s: r.n for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    parts = state.count()
    if any(load.get(s, 0) > quota[s] for s in range(n_shards)):
        P = stage(running(state, ["s"], [F.col("_g")], F.col("n"), parts), "over")
        fit = F.greatest(F.lit(0), F.least(F.col("n"), F.get(quotas, F.col("s")) - F.col("before")))
        over = running(P.select("_g", "s", (F.col("n") - fit).alias("n")).where("n > 0"), [], [F.col("_g"), F.col("s")], F.col("n"), parts)
        spaces = _intervals([(s, quota[s] - load.get(s, 0)) for s in range(n_shards)])
        cut = over.select("_g", F.col("before").alias("a"), (F.col("before") + F.col("n")).alias("b"), F.explode(spaces).alias("i"))
        cut = cut.select("_g", F.col("i.shard").alias("s"), (F.least("b", "i.hi") - F.greatest("a", "i.lo")).alias("n")).where("n > 0")
        state = stage(P.select("_g", "s", fit.alias("n")).unionByName(cut).groupBy("_g", "s").agg(F.sum("n").alias("n")).where("n > 0"), "parts")
        load = {r.s: r.n for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        parts = state.count()

    # Ranks: of a part within its shard, of a row within its group, of unlinked rows among themselves.
    slots = running(state, ["s"], [F.col("_g")], F.col("n"), parts, "base")
    inside = W.partitionBy("_g").orderBy("s").rowsBetween(W.unboundedPreceding, -1)  # one row per shard at most
    lists = slots.withColumn("lo", F.coalesce(F.sum("n").over(inside), F.lit(0)).cast("long")).groupBy("_g").agg(
        F.collect_list(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), F.col("s").alias("shard"), "base")).alias("parts"))
    order = [F.col("_h"), F.col("_id"), *map(F.col, kept)]
    one = F.lit(1).cast("long")
    linked = running(S.join(pairs, ["_g", "_s"], "left_semi").select(S.columns), ["_g"], order, one, n, "rank")
    linked = linked.join(pairs.join(lists, "_g"), ["_g", "_s"])
    linked = linked.withColumn("_i", _pick(F.col("parts"), F.col("rank")))
    linked = linked.select("_id", *kept, F.col("_i.shard").alias("shard"), (F.col("_i.base") + F.col("rank") - F.col("_i.lo")).alias("slot"))
    alone = running(S.join(pairs, ["_g", "_s"], "left_anti").select(S.columns), [], order, one, n, "rank")
    alone = alone.withColumn("_i", _pick(_intervals([(s, quota[s] - load.get(s, 0)) for s in range(n_shards)]), F.col("rank")))
    loads = F.array(*[F.lit(load.get(s, 0)).cast("long") for s in range(n_shards)])
    alone = alone.select("_id", *kept, F.col("_i.shard").alias("shard"), (F.get(loads, F.col("_i.shard")) + F.col("rank") - F.col("_i.lo")).alias("slot"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id), *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
