"""Exact top-k search among patch embeddings by bounds from segment statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches
from .vectors import matrix_groups, unpack

LEVELS = (1, 4, 16)  # segments per vector, coarse to fine
SCALE = 256


def segment_stats(X: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment sqrt(length) times mean, then sqrt(length) times deviation.

    The product of two rows of these is at least the inner product of the vectors:
    within a segment the means multiply exactly and Cauchy-Schwarz bounds the rest.
    It is the counterpart of the lower bound on their distance.
    """
    parts = np.array_split(np.arange(X.shape[1]), min(segments, X.shape[1]))
    at = [p[0] for p in parts]
    root = np.sqrt([len(p) for p in parts])
    mean = np.add.reduceat(X, at, axis=1) / root**2
    spread = np.maximum(np.add.reduceat(X * X, at, axis=1) / root**2 - mean**2, 0)
    # Rounding must not make a deviation too small.
    top = np.maximum.reduceat(np.abs(X), at, axis=1)
    return np.hstack([mean * root, np.sqrt(spread + 1e-12 * top**2) * root])


class _Best:
    """The best k so far of each query of one block."""

    def __init__(self, ids: np.ndarray, Q: np.ndarray, k: int):
        self.ids, self.Q, self.k = ids, Q, k
        self.stats = [segment_stats(Q, s) for s in LEVELS]
        self.q = self.x = self.s = np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, X: np.ndarray) -> None:
        """Take in a block: bounds first, coarse to fine, exact products for the pairs that survive."""
        pairs = None
        for stats, s in zip(self.stats, LEVELS):
            if pairs is None and np.isneginf(self.least).any():
                break
            xs = segment_stats(X, s)
            slack = 1e-9 * (1 + np.abs(self.least))
            if pairs is None:
                q, x = np.nonzero(stats @ xs.T >= (self.least - slack)[:, None])
                if len(q) * 8 > len(self.ids) * len(ids):
                    continue  # most survive: the next level looks at the whole block too
                pairs = q, x
            else:
                q, x = pairs
                keep = np.einsum("ij,ij->i", stats[q], xs[x]) >= (self.least - slack)[q]
                pairs = q[keep], x[keep]
        if pairs is None:
            S = _products(self.Q, X)
            S = np.where(self.ids[:, None] == ids[None, :], np.iinfo(np.int64).min, S)
            kth = np.partition(S, -self.k, axis=1)[:, -self.k] if S.shape[1] >= self.k else np.full(len(S), np.iinfo(np.int64).min)
            q, x = np.nonzero((S >= kth[:, None]) & (S >= self.least[:, None]) & (S > np.iinfo(np.int64).min))
            s = S[q, x]
        else:
            q, x = pairs
            own = self.ids[q] != ids[x]
            q, x = q[own], x[own]
            s = _row_products(self.Q, X, q, x)
            keep = s >= self.least[q]
            q, x, s = q[keep], x[keep], s[keep]
        if not len(q):
            return
        self.q, self.x, self.s = np.r_[self.q, q], np.r_[self.x, ids[x]], np.r_[self.s, s]
        o = np.lexsort((self.x, -self.s, self.q))
        self.q, self.x, self.s = self.q[o], self.x[o], self.s[o]
        first = np.searchsorted(self.q, self.q)
        keep = np.arange(len(self.q)) - first < self.k
        self.q, self.x, self.s = self.q[keep], self.x[keep], self.s[keep]
        full, n = np.unique(self.q, return_counts=True)
        last = np.searchsorted(self.q, full, side="right") - 1
        done = n == self.k
        self.least[full[done]] = self.s[last[done]]


def _fits(Q, X) -> bool:
    return float(np.abs(Q).max(initial=0)) * float(np.abs(X).max(initial=0)) * Q.shape[1] < 2**53


def _products(Q, X):
    """Integer inner products; in floating point only where that is exact."""
    return (Q @ X.T).astype(np.int64) if _fits(Q, X) else Q.astype(np.int64) @ X.astype(np.int64).T


def _row_products(Q, X, q, x):
    out = np.empty(len(q), np.int64)
    kind = np.float64 if _fits(Q, X) else np.int64
    for a in range(0, len(q), 1 << 18):
        b = slice(a, a + (1 << 18))
        out[b] = np.einsum("ij,ij->i", Q[q[b]].astype(kind), X[x[b]].astype(kind))
    return out


def _packer(rows: int):
    def pack(it):
        schema = pa.schema([("d", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary())])
        held: dict = {}

        def out():
            for b in it:
                ids = np.asarray(b.column(0))
                for d, at, M in matrix_groups(b.column(1)):
                    held.setdefault(d, []).append((ids[at], np.floor(M * SCALE)))
                    if sum(len(i) for i, _ in held[d]) >= rows:
                        yield from flush(d)
            for d in [d for d in held if held[d]]:
                yield from flush(d)

        def flush(d):
            ids, M = np.concatenate([i for i, _ in held[d]]), np.concatenate([m for _, m in held[d]])
            held[d] = []
            for a in range(0, len(ids), rows):
                yield d, ids[a:a + rows].astype(np.int64).tobytes(), M[a:a + rows].tobytes()

        yield from batches(schema, out(), 4)
    return pack


def nearest_patches(queries: DataFrame, patches: DataFrame, k: int = 5, id: str = "patch_id", vec: str = "vec",
                    block: int = 2048) -> DataFrame:
    """The ``k`` patches most like each query patch: ``query_id, rank, id, score``.

    queries, patches    ``patch_id`` (integer) and ``vec`` of embedded patches
    score               inner product of the vectors, every component x as floor(256 x)

    Exact: every patch but those with the query's own id is a candidate, ties go to the
    smaller id, and a query with fewer candidates gets them all.  Blocks of queries meet
    blocks of patches on the number of the pair of groups; per pair, segment means and
    deviations (1, 4, then 16 segments) bound the score, and only pairs that can still
    reach the query's k-th best are computed in full.  A task hands on k rows a query.
    Null ids, vectors that are null or empty or hold null or non-finite components, and
    vectors of another length than the query's take no part.  Repeated rows are separate
    candidates; queries must have distinct ids.  Empty tables give an empty result, and
    other columns do not matter.
    """
    pick = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    Q, X = pick(queries), pick(patches)
    nq, nx = (max(1, math.ceil(df.count() / r)) for df, r in ((Q, block), (X, 4 * block)))
    kind = "d int, ids binary, codes binary"
    Qb = Q.repartition(nq, F.pmod(F.xxhash64("id"), F.lit(nq))).mapInArrow(_packer(block), kind)
    Qb = Qb.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(nq)))
    Qb = Qb.select("g", F.col("d"), F.col("ids").alias("qids"), F.col("codes").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("h"))
    Xb = X.repartition(nx, F.pmod(F.xxhash64("id"), F.lit(nx))).mapInArrow(_packer(block), kind)
    Xb = Xb.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("g"), "d", "ids", "codes", F.pmod(F.xxhash64("ids"), F.lit(nx)).cast("int").alias("h"))
    # The planner takes the exploded blocks to be as small as the queries; the hint keeps them from being broadcast.
    met = Qb.hint("merge").join(Xb, ["g", "h", "d"]).select("d", "qids", "q", "ids", "codes")

    def search(it):
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        best: dict = {}

        def done():
            for b in best.values():
                yield from zip(b.ids[b.q].tolist(), b.x.tolist(), b.s.tolist())
            best.clear()

        def rows():
            for batch in it:
                for d, qids, q, ids, codes in zip(*batch.columns):
                    qids, d = qids.as_py(), d.as_py()
                    if (qids, d) not in best:
                        if len(best) >= 16:
                            yield from done()
                        best[qids, d] = _Best(unpack(qids, np.int64), unpack(q.as_py(), np.float64, d), k)
                    best[qids, d].offer(unpack(ids.as_py(), np.int64), unpack(codes.as_py(), np.float64, d))
            yield from done()

        yield from batches(schema, rows(), 20_000)

    found = met.mapInArrow(search, "query_id bigint, id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
