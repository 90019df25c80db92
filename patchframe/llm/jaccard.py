"""Jaccard join of annotation texts on word n-grams along chosen paths.

Sets are split recursively on shared n-grams that a hash of the path picks: a set of
size ``s`` follows each of its n-grams with chance 1 / (threshold * s), so two sets that
reach the threshold share at least one child on average.  Small buckets are compared
in full.  Large ones are split again on several n-grams a set, so that hardly any pair
in one is lost however deep it lies, and independent runs repeat the search until the
recall asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_stage, stage
from .union import components, local_roots
from .words import _LOWER, ODD, hashes, mix, text_chunks, tokens


def ngram_sets(column: pa.Array, n: int):
    """For runs of texts: first row, offsets of their sets, and the sets' n-gram hashes, ascending within a set.

    Words stand between white space, ASCII letters in lower case.  A text with fewer
    than ``n`` words but at least one has one n-gram, all of it.
    """
    for row, offsets, data in text_chunks(column, 1 << 18):
        low = _LOWER[data]
        s, e, text = tokens(low, offsets)
        h = hashes(low, s, e)
        count = np.bincount(text, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(count)])
        # Short texts are filled up with a mark, so each has a gram.
        grams = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
        at = np.repeat(first[:-1], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        stop = np.repeat(first[1:], grams)
        padded = np.append(h, np.zeros(n, np.uint64))
        g = np.zeros(len(at), np.uint64)
        for j in range(n):
            inside = at + j < stop
            g = g * np.uint64(ODD) + np.where(inside, padded[np.minimum(at + j, len(h))], np.uint64(j + 1))
        g = mix(g)
        owner = np.repeat(np.arange(len(count)), grams)
        o = np.lexsort((g, owner))
        g, owner = g[o], owner[o]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[new], owner[new]
        yield row, np.searchsorted(owner, np.arange(len(count) + 1)), g


#: N-grams that a pair at the threshold is expected to follow together from a large bucket on.
DEEPER = 4


def _picked(g: np.ndarray, path: np.ndarray, size: np.ndarray, threshold: float, used: int = 0, times: int = 1) -> np.ndarray:
    """Which n-grams a set of ``size`` follows from ``path`` on, ``used`` of them being behind it.

    Sets that reach the threshold have threshold * size n-grams in common, of which
    ``times`` are expected to be picked.
    """
    odds = np.minimum(1.0, times / np.maximum(threshold * size - used, 1e-9))
    return mix(g ^ path) <= (odds * float(2**64 - 2049)).astype(np.uint64)


def _child(path: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(np.atleast_1d(path) * np.uint64(ODD) + g)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has been compared with at least this chance, at any depth.

    A bucket that has to be split loses it with q = exp(-DEEPER * (1 - q)) at most, as its
    children may be split too, and a run with exp(-(1 - q)).
    """
    q = 0.0
    for _ in range(60):
        q = math.exp(-DEEPER * (1 - q))
    return max(1, math.ceil(-math.log(max(1 - recall, 1e-12)) / (1 - q)))


def similar_texts(annotations: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9996, small: int = 48, block: int = 384,
                  id: str = "id", text: str = "name", seed: int = 17) -> DataFrame:
    """Groups of annotations with similar texts: ``id, n_links, component_id``.

    annotations    id (integer) and free text (``name``)
    n_links        other annotations whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more
    component_id   smallest id reachable by links, the own one included

    Texts with equal sets are folded to one class and counted.  A class takes part in a
    bucket for each picked n-gram of each of ``runs_for(recall)`` runs.  A bucket of up
    to ``small`` classes is compared in full, once for all buckets with the same members.  A larger
    one is split again on n-grams not yet in its path, ``DEEPER`` of those that a pair at the
    threshold shares; where most of its classes follow the same n-gram, more splitting
    cannot part them, and it is compared in pairs of blocks of ``block`` classes, together
    with the other buckets that hold mostly the same classes.  So are its classes whose path
    holds all that a pair has to share.  Every comparison is exact.  A pair counts in the smallest
    of the buckets that it shares, and a task hands on counts and a spanning forest.

    So links are exact, and a pair at the threshold is missed with a chance of 1 - recall,
    whatever the size of its buckets (paths taken as independent).
    Texts without words, null ids and null texts link with nothing.  Repeated rows link with each other.  An
    empty table gives an empty result; other columns do not matter.
    """
    runs = runs_for(recall)
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(ODD) + np.uint64(seed))
    A = annotations.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))

    def scan(it):
        schema = pa.schema([("id", pa.int64()), ("c", pa.binary()), ("picks", pa.list_(pa.int64()))])

        def rows():
            for b in it:
                ids = b.column(0).to_pylist()
                for row, at, g in ngram_sets(b.column(1), n):
                    size = np.repeat(np.diff(at), np.diff(at))
                    owner, child = [], []
                    for s in seeds:
                        k = np.flatnonzero(_picked(g, s, size, threshold))
                        owner.append(k)
                        child.append(_child(s, g[k]))
                    owner, child = np.concatenate(owner), np.concatenate(child).view(np.int64)
                    o = np.argsort(owner, kind="stable")
                    owner, child = owner[o], child[o]
                    cut = np.searchsorted(owner, at)
                    for i in range(len(at) - 1):
                        if ids[row + i] is not None:
                            full = at[i + 1] > at[i]
                            yield ids[row + i], hashlib.blake2b(g[at[i]:at[i + 1]].tobytes(), digest_size=16).digest() if full else None, child[cut[i]:cut[i + 1]].tolist() if full else None
        yield from batches(schema, rows(), 5000)

    S = stage(A.mapInArrow(scan, "id bigint, c binary, picks array<bigint>"), "scanned")
    C = stage(S.where("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"), F.any_value("picks").alias("picks")), "classes")
    members = C.select("c", F.explode("picks").alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stage(members.join(sizes, "key"), "members")

    # The sets of classes that share a bucket, each from one of its annotations.
    wanted = members.select("c").distinct().join(C.select("c", "copies", "rep"), "c").withColumnRenamed("rep", "id")

    def sets(it):
        schema = pa.schema([("c", pa.binary()), ("copies", pa.int64()), ("g", pa.binary())])

        def rows():
            for b in it:
                c, copies = b.column(0).to_pylist(), b.column(1).to_pylist()
                for row, at, g in ngram_sets(b.column(2), n):
                    for i in range(len(at) - 1):
                        own = g[at[i]:at[i + 1]].tobytes()
                        # An id may stand for several texts; the digest says which is meant.
                        if at[i + 1] > at[i] and hashlib.blake2b(own, digest_size=16).digest() == c[row + i]:
                            yield c[row + i], copies[row + i], own
        yield from batches(schema, rows(), 2000)

    G = A.where("id IS NOT NULL").join(wanted, "id").select("c", "copies", "t").mapInArrow(sets, "c binary, copies bigint, g binary")
    G = stage(G.groupBy("c").agg(F.any_value("copies").alias("copies"), F.any_value("g").alias("g")), "sets")

    leaves = [_same_lists(members.where(F.col("m") <= small))]
    whole: list[DataFrame] = []  # large buckets that are compared in block pairs
    large = members.where(F.col("m") > small).select("key", "c", "m", F.array().cast("array<bigint>").alias("used"))
    made: list[DataFrame] = []
    while not large.isEmpty():
        own = G.join(large.select("c").distinct(), "c", "left_semi") if not made else made[0]
        if not made:
            made.append(stage(own, "large-sets"))
        def sets_of(some: DataFrame) -> DataFrame:
            paths = some.groupBy("c").agg(F.collect_list(F.struct("key", "m", "used")).alias("paths"))
            return made[0].join(paths, "c").select("c", "g", "paths")

        def children(batch):
            for c, g, paths in zip(*(x.to_pylist() for x in batch.columns)):
                g = np.frombuffer(g, np.uint64)
                for p in paths:
                    path = np.array([p["key"]], np.int64).view(np.uint64)
                    # A first bucket's key does not say its n-gram, but the set has it.
                    used = np.array(p["used"], np.int64).view(np.uint64) if p["used"] else g[(_child(seeds[:, None], g) == path).any(axis=0)]
                    behind = used.view(np.int64).tolist()
                    if threshold * len(g) <= len(used) + 1e-9:  # a pair may have nothing more in common
                        yield p["key"], p["m"], c, int(mix(~path).view(np.int64)[0]), behind, True
                    k = g[_picked(g, path, np.array([len(g)]), threshold, len(used), DEEPER)]
                    for one in k[~np.isin(k, used)]:
                        yield p["key"], p["m"], c, int(_child(path, one[None]).view(np.int64)[0]), [*behind, int(one.astype(np.int64))], False

        def tally(it):
            schema = pa.schema([(x, pa.int64()) for x in ("key", "m", "child", "n")])

            def rows():
                counts: Counter = Counter()
                for b in it:
                    counts.update((key, m, child) for key, m, _, child, _, _ in children(b))
                    if len(counts) > 200_000:
                        yield from ((*k, n) for k, n in counts.items())
                        counts.clear()
                yield from ((*k, n) for k, n in counts.items())
            yield from batches(schema, rows(), 5000)

        def split(it):
            schema = pa.schema([("key", pa.int64()), ("m", pa.int64()), ("c", pa.binary()), ("child", pa.int64()), ("used", pa.list_(pa.int64())), ("done", pa.bool_())])
            yield from batches(schema, (r for b in it for r in children(b)), 5000)

        # Counts first, summed where the sets lie: classes of buckets that are not to be split make no rows.
        of = sets_of(large).mapInArrow(tally, "key bigint, m bigint, child bigint, n bigint")
        of = stage(of.groupBy("key", "m", "child").agg(F.sum("n").alias("n")), "children")
        top = of.groupBy("key").agg(F.max(F.col("n") / F.col("m")).alias("share"))
        # More than half of a bucket on one n-gram: it holds near copies, or as good as.
        dense = stage(top.where("share > 0.5").select("key"), "dense")
        whole.append(large.join(dense, "key", "left_semi").select("key", "c", "m"))
        E = sets_of(large.join(dense, "key", "left_anti")).mapInArrow(split, "key bigint, m bigint, c binary, child bigint, used array<bigint>, done boolean")
        kids = E.join(of.where("n > 1").select("key", "child", "n"), ["key", "child"])
        kids = stage(kids.select(F.col("child").alias("key"), "c", F.col("n").alias("m"), "used", "done"), "members")
        leaves.append(_same_lists(kids.where(F.col("m") <= small)))
        whole.append(kids.where((F.col("m") > small) & F.col("done")).select("key", "c", "m"))
        large = kids.where((F.col("m") > small) & ~F.col("done")).drop("done")
        drop_stage(of)

    if whole:
        D = whole[0]
        for x in whole[1:]:
            D = D.unionByName(x)
        leaves.append(_overlapping(stage(D.distinct(), "dense-members")))
    L = leaves[0]
    for x in leaves[1:]:
        L = L.unionByName(x)
    L = stage(L, "leaves")
    every = L.groupBy("c").agg(F.sort_array(F.collect_set("key")).alias("every"))
    R = L.withColumn("nb", F.ceil(F.col("m") / F.when(F.col("m") > small, block).otherwise(small)).cast("int"))
    R = R.withColumn("b", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    R = R.select("key", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "c")
    W = R.join(G.join(every, "c"), "c").select("key", "b1", "b2", "b", "c", "copies", "g", "every")
    W = W.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def compare(it):
        schema = pa.schema([("c", pa.binary()), ("n", pa.int64()), ("other", pa.binary())])

        def rows():
            held: list = []
            now = None
            for b in it:
                for r in zip(*(x.to_pylist() for x in b.columns)):
                    if r[:3] != now:
                        yield from _links(now, held, threshold)
                        now, held = r[:3], []
                    held.append(r[3:])
            yield from _links(now, held, threshold)
        yield from batches(schema, rows(), 5000)

    found = stage(W.mapInArrow(compare, "c binary, n bigint, other binary"), "found")
    linked = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("c").alias("a"), F.col("other").alias("b")))
    K = C.select("c", "copies", "rep").join(linked, "c", "left").join(roots.withColumnRenamed("v", "c"), "c", "left").select(
        "c", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"), "rep")
    K = stage(K, "classes")
    least = K.groupBy("root").agg(F.min("rep").alias("component_id"))
    K = K.join(least, "root").select("c", "n_links", "component_id")
    lone = A.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = S.select("id", "c").join(K, "c", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(lone)
    return out if id == "id" else out.withColumnRenamed("id", id)


def _same_lists(members: DataFrame) -> DataFrame:
    """Buckets of bounded size, one for each list of members."""
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("l"))
    one = lists.groupBy("l").agg(F.min("key").alias("key"))
    return one.select("key", F.explode("l").alias("c"), F.size("l").cast("long").alias("m"))


def _overlapping(members: DataFrame) -> DataFrame:
    """Large buckets (``key, c, m``), those with mostly the same members as one bucket.

    A group of near copies lies in several large buckets.  Each class names the largest of
    its buckets; a bucket most of whose members name another one, which names itself, goes
    into it.  The union holds every pair of either.  It is taken only where comparing it is
    no more work than comparing its buckets one by one.
    """
    lead = members.groupBy("c").agg(F.max(F.struct("m", "key"))["key"].alias("lead"))
    votes = members.join(lead, "c").groupBy("key", "m", "lead").agg(F.count(F.lit(1)).alias("n"))
    goes = votes.groupBy("key", "m").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"), F.max("n").alias("n"))
    goes = goes.select("key", "m", F.when(F.col("n") * 2 > F.col("m"), F.col("lead")).otherwise(F.col("key")).alias("lead"))
    heads = goes.where("key = lead").select(F.col("key").alias("lead"), F.lit(True).alias("head"))
    goes = goes.join(heads, "lead", "left").select("key", "m", F.when(F.col("head"), F.col("lead")).otherwise(F.col("key")).alias("lead"))
    goes = stage(goes, "dense-leads")
    apart = goes.groupBy("lead").agg(F.sum(F.col("m").cast("double") ** 2).alias("work"))
    united = stage(members.join(goes.select("key", "lead"), "key").select("lead", "c").distinct(), "dense-united")
    size = united.groupBy("lead").agg(F.count(F.lit(1)).alias("size")).join(apart, "lead")
    fold = size.where(F.col("size").cast("double") ** 2 <= F.col("work"))
    one = united.join(fold.select("lead", "size"), "lead").select(F.col("lead").alias("key"), "c", F.col("size").alias("m"))
    kept = goes.join(fold, "lead", "left_anti").select("key")
    return one.unionByName(members.join(kept, "key", "left_semi").select("key", "c", "m"))


def _links(key, rows: list, threshold: float):
    """Links of one bucket, or one pair of its blocks, that no smaller bucket has counted: ``c, count, another linked``."""
    if len(rows) < 2:
        return
    rows.sort(key=lambda r: r[1])
    side = np.array([r[0] for r in rows])
    copies = np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    A, B = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
    if not len(A) or not len(B):
        return
    who = np.repeat(np.arange(len(rows)), size)
    g, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    who, col = who[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    both = np.zeros((len(A), len(B)), np.float32)
    ia, ib = np.full(len(rows), -1), np.full(len(rows), -1)
    ia[A], ib[B] = np.arange(len(A)), np.arange(len(B))
    step = max(256, (1 << 21) // len(rows))
    for lo in range(0, int(shared.sum()), step):  # bounded slices of the incidence matrix
        p, q = np.searchsorted(col, [lo, lo + step])
        X = np.zeros((len(rows), step), np.float32)
        X[who[p:q], col[p:q] - lo] = 1
        both += X[A] @ X[B].T
    # Exact in whole numbers: both / (a + b - both) >= threshold, up to rounding of the threshold.
    total = size[A][:, None] + size[B][None, :] - both
    i, j = np.nonzero(both + 1e-9 * total >= threshold * total)
    i, j = A[i], B[j]
    keep = i < j if key[1] == key[2] else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    if not len(i):
        return
    every = [np.array(r[4]) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(e) for e in every])
    names = np.concatenate(every)
    before = names < key[0]
    name, at = np.unique(names[before], return_inverse=True)
    seen = np.zeros((len(rows), len(name)), bool)
    seen[owner[before], at] = True
    links = np.zeros(len(rows), np.int64)
    for a in range(0, len(i), 1 << 14):
        p, q = i[a:a + (1 << 14)], j[a:a + (1 << 14)]
        new = ~(seen[p] & seen[q]).any(axis=1)
        np.add.at(links, p[new], copies[q[new]])
        np.add.at(links, q[new], copies[p[new]])
    root = local_roots(len(rows), i, j)
    for k in np.flatnonzero((links > 0) | (root != np.arange(len(rows)))):
        yield rows[k][1], int(links[k]), rows[root[k]][1]
