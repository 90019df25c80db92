"""Near-duplicate patches by a forest of random-projection trees with overlapping halves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stage
from .union import components, local_roots
from .vectors import matrix_groups


LENGTHS = 1000  # vector lengths that get trees


class Tree:
    """One tree: per inner node a direction, a threshold and two children (negative: leaf)."""

    def __init__(self, X: np.ndarray, leaf: int, margin: float, seed: int):
        rng = np.random.default_rng(seed)
        self.margin, self.direction, self.at, self.child = margin, [], [], []
        self.leaves = 0
        self.root = self._grow(X, np.arange(len(X)), leaf, rng, 0)
        self.direction = np.array(self.direction).reshape(len(self.at), X.shape[1])

    def _grow(self, X, rows, leaf, rng, depth):
        if len(rows) > leaf and depth < 48:
            for _ in range(3):  # another direction where this one tells too few apart
                r = rng.normal(size=X.shape[1])
                r /= np.linalg.norm(r)
                p = X[rows] @ r
                cut = float(np.median(p))
                left, right = rows[p <= cut + self.margin], rows[p >= cut - self.margin]
                if max(len(left), len(right)) <= 0.9 * len(rows):
                    me = len(self.at)
                    self.direction.append(r)
                    self.at.append(cut)
                    self.child.append(None)
                    self.child[me] = (self._grow(X, left, leaf, rng, depth + 1), self._grow(X, right, leaf, rng, depth + 1))
                    return me
        self.leaves += 1
        return -self.leaves

    def route(self, X: np.ndarray):
        """Pairs (row, leaf number): a row within the margin of a threshold goes both ways."""
        todo, rows, leaves = [(self.root, np.arange(len(X)))], [], []
        while todo:
            node, r = todo.pop()
            if not len(r):
                continue
            if node < 0:
                rows.append(r)
                leaves.append(np.full(len(r), -node - 1))
                continue
            p = X[r] @ self.direction[node]
            todo += [(self.child[node][0], r[p <= self.at[node] + self.margin]), (self.child[node][1], r[p >= self.at[node] - self.margin])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _unit(M: np.ndarray):
    """Rows that are not zero, and those rows with length one (scaled first, so squares neither vanish nor overflow)."""
    top = np.abs(M).max(axis=1)
    ok = np.flatnonzero(top > 0)
    U = M[ok] / top[ok][:, None]
    return ok, U / np.linalg.norm(U, axis=1)[:, None]


def near_duplicate_patches(patches: DataFrame, threshold: float = 0.95, trees: int = 6, leaf: int = 512, spill: float = 0.35,
                           sample_values: int = 4_000_000, block: int = 2048, seed: int = 11, id: str = "patch_id", vec: str = "vec") -> DataFrame:
    """Which embedded patches repeat each other: ``id, n_links, component_id, kept``.

    patches        ``patch_id`` (integer) and ``vec``
    n_links        other patches linked directly: found, and cosine >= ``threshold`` in double precision
    component_id   smallest id reachable by links, the patch's own included
    kept           the patch is its component's smallest

    Equal vectors are folded first and counted.  ``trees`` random-projection trees are
    fitted on a bounded sample (``sample_values`` numbers, rows by hash of the id); every
    vector is routed through all of them, both ways when it lies within ``spill`` standard
    deviations of a projected link of a threshold.  Vectors are compared within leaves,
    in pairs of blocks of about ``block`` rows, so a leaf of many near copies is many
    tasks.  Lengths beyond the first LENGTHS have no trees and are one leaf each.  A pair that shares several leaves counts in the smallest only; a block pair
    hands on counts and a spanning forest of its links, never the links themselves.
    Links of a pair at the threshold are missed with a small probability (recall is
    measured in the tests); none below the threshold is reported.

    Null, empty, zero and non-finite vectors link with nothing; vectors of different
    lengths are never linked.  Each input row has one row in the result: rows that repeat
    an id with an equal vector link with each other and all are kept or none is.  Null ids
    are in no link and their own component.  An empty table gives an empty result.
    """
    spark = patches.sparkSession
    P = patches.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("v"))
    narrow = dict(P.dtypes)["v"] == "array<float>"
    kind, size = (np.float32, 4) if narrow else (np.float64, 8)
    if not narrow:
        P = P.withColumn("v", F.col("v").cast("array<double>"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall(
        "v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    folded = stage(P.where(F.coalesce(usable, F.lit(False))).groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "folded")
    dims = [r.d for r in folded.select(F.size("v").alias("d")).distinct().limit(LENGTHS).collect()]
    n = folded.count()

    forest: dict = {}
    margin = spill * math.sqrt(max(2 - 2 * threshold, 1e-12))
    first = 0
    for d in sorted(dims):
        own = folded.where(F.size("v") == d)
        rows = max(64, min(20_000, sample_values // d))
        taken = own.orderBy(F.xxhash64("rep")).limit(rows).select("v").toArrow()
        X = np.vstack([_unit(M)[1] for _, _, M in matrix_groups(taken.column("v"))])
        part = leaf if len(X) < rows else max(48, round(leaf * len(X) / max(n, 1)))
        grown = []
        for t in range(trees):
            tree = Tree(X, part, margin / math.sqrt(d), seed + t)
            grown.append((first, tree))
            first += tree.leaves
        forest[d] = grown

    def route(it):
        schema = pa.schema([("leaf", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("x", pa.binary()), ("all", pa.binary())])

        def rows():
            for b in it:
                ids, copies = np.asarray(b.column(1)), np.asarray(b.column(2))
                for d, at, M in matrix_groups(b.column(0)):
                    ok, U = _unit(M)
                    at = at[ok]
                    # A length without trees is one leaf, compared in block pairs as any.
                    pairs = [(r, leaf + start) for start, tree in forest[d] for r, leaf in [tree.route(U)]] if d in forest else [(np.arange(len(U)), np.full(len(U), -d))]
                    r, leaves = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                    o = np.lexsort((leaves, r))
                    r, leaves = r[o], leaves[o]
                    cut = np.searchsorted(r, np.arange(len(at) + 1))
                    raw = M[ok].astype(kind)
                    for i in range(len(at)):
                        mine = leaves[cut[i]:cut[i + 1]]
                        x, every = raw[i].tobytes(), mine.astype(np.int32).tobytes()
                        for one in mine.tolist():
                            yield one, int(ids[at[i]]), int(copies[at[i]]), x, every
        yield from batches(schema, rows(), 4000)

    routed = stage(folded.select("v", "rep", "copies").mapInArrow(route, "leaf bigint, id bigint, copies bigint, x binary, all binary"), "routed")
    # At most trees x leaves rows, a number the bounded sample sets; looked up by a join all the same.
    counts = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("x")).alias("b"))
    counts = counts.where("n > 1").select("leaf", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("nb"))
    B = routed.join(counts, "leaf").withColumn("b", F.pmod(F.xxhash64("id", F.lit(5)), F.col("nb")).cast("int"))
    B = B.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    B = B.select("leaf", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "id", "copies", "x", "all")

    def compare(key, t):
        return _compare(key[0].as_py(), key[1].as_py(), key[2].as_py(), t, threshold, kind)

    found = stage(B.groupBy("leaf", "b1", "b2").applyInArrow(compare, "id bigint, n bigint, other bigint"), "found")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    reps = folded.join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select(
        F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    fits = P.withColumn("w", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    out = fits.join(reps, "w", "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))


def _compare(leaf: int, b1: int, b2: int, t: pa.Table, threshold: float, kind) -> pa.Table:
    """Links between two blocks of a leaf (or within one) that no smaller leaf has counted."""
    ids, copies, side = (np.asarray(t.column(c)) for c in ("id", "copies", "b"))
    o = np.argsort(ids, kind="stable")
    ids, copies, side = ids[o], copies[o], side[o]
    n = len(ids)
    raw = t.column("x").to_pylist()
    M = np.stack([np.frombuffer(raw[i], kind) for i in o]).astype(np.float64)
    U = _unit(M)[1]
    lists = t.column("all").to_pylist()
    each = [np.frombuffer(lists[i], np.int32) for i in o]
    who = np.repeat(np.arange(n), [len(e) for e in each])
    what = np.concatenate(each)
    before = what < leaf
    names, col = np.unique(what[before], return_inverse=True)
    seen = np.zeros((n, len(names)), np.float32)
    seen[who[before], col] = 1
    links, I, J = np.zeros(n, np.int64), [], []
    A = np.flatnonzero(side == b1)
    C = np.flatnonzero(side == b2)
    V = U.astype(np.float32)
    for a in range(0, len(A), 256):
        rows = A[a:a + 256]
        cols = C[a:] if b1 == b2 else C
        # Single precision finds what may be a link, double precision decides.
        i, j = np.nonzero(V[rows] @ V[cols].T >= np.float32(threshold - 1e-4))
        i, j = rows[i], cols[j]
        keep = i < j if b1 == b2 else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 1 << 16):
            s = slice(c, c + (1 << 16))
            keep[:len(i)][s] = np.einsum("ij,ij->i", U[i[s]], U[j[s]]) >= threshold
        i, j = i[keep[:len(i)]], j[keep[:len(i)]]
        if not len(i):
            continue
        for c in range(0, len(i), 1 << 16):
            p, q = i[c:c + (1 << 16)], j[c:c + (1 << 16)]
            new = ~(seen[p] * seen[q]).any(axis=1) if len(names) else np.ones(len(p), bool)
            np.add.at(links, p[new], copies[q[new]])
            np.add.at(links, q[new], copies[p[new]])
        # Only a spanning forest of what is linked so far is kept.
        I.append(i)
        J.append(j)
        root = local_roots(n, np.concatenate(I), np.concatenate(J))
        I, J = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]]
    other = np.arange(n)
    if I:
        other[I[0]] = J[0]
    out = np.flatnonzero((links > 0) | (other != np.arange(n)))
    return pa.table({"id": ids[out], "n": links[out], "other": ids[other[out]]})
