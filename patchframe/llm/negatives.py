"""Hard negatives for embedded patches, found by angles to reference directions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, stage
from .vectors import matrix_groups, unpack

SCALE = 256
REFERENCES = 16  # directions
SAMPLE_ROWS, SAMPLE_VALUES = 2000, 2_000_000  # rows, and numbers, the directions are picked from
PACK = 512  # block summaries per row
# Stored angles are single precision, and an arc cosine near 0 or pi is off by up to 5e-8.
ANGLE_SLACK = 1e-6
LOW, HIGH = -(2**63), 2**63 - 1


def pick_references(X: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """``n`` directions far apart in angle, chosen one after the other among the rows of ``X``."""
    norm = np.linalg.norm(X, axis=1)
    U = X[(norm > 0) & np.isfinite(norm)]
    if not len(U):
        return np.zeros((0, X.shape[1]))
    U = U / np.linalg.norm(U, axis=1)[:, None]
    taken = [0]
    nearest = U @ U[0]
    while len(taken) < min(n, len(U)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        taken.append(far)
        nearest = np.maximum(nearest, U @ U[far])
    return U[taken]


def angles_to(C: np.ndarray, R: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of every row and its angles to the directions ``R``, in single precision."""
    norm = np.linalg.norm(C, axis=1)
    safe = np.where(norm > 0, norm, 1)
    return norm, np.arccos(np.clip((C @ R.T) / safe[:, None], -1, 1)).astype(np.float32)


def cosine_interval(a_low, a_high, x_low, x_high):
    """Bounds on the cosine of two vectors whose angles to one direction lie in the given intervals.

    The angle between them is at least the difference of their angles to the direction,
    at most their sum and at most what is left of the full turn.
    """
    least = np.maximum(np.maximum(a_low - x_high, x_low - a_high), 0)
    most = np.minimum(a_high + x_high, 2 * np.pi - (a_low + x_low))
    return least, most


def score_bounds(na, nx, least, most):
    """Bounds on the inner product from norms and an interval of angles, widened for rounding."""
    top = np.cos(np.clip(least - ANGLE_SLACK, 0, np.pi), dtype=np.float64)
    low = np.cos(np.clip(most + ANGLE_SLACK, 0, np.pi), dtype=np.float64)
    both = na * nx
    slack = both * 1e-9 + 1e-3
    return _long(both * low - slack), _long(both * top + slack)


def _long(bound: np.ndarray) -> np.ndarray:
    """Bounds on scores that count as the nearest long."""
    return np.clip(bound, -2.0**63, 2.0**63, out=bound) if np.abs(bound).max(initial=0) > 2**62 else bound


def _summary(norms, angles):
    """Smallest and largest norm, then smallest and largest angle per direction."""
    return np.r_[norms.min(), norms.max(), angles.min(axis=0, initial=4), angles.max(axis=0, initial=0)].astype(np.float64)


def _block_bounds(G: np.ndarray, H: np.ndarray):
    """Bounds on the scores between every block of ``G`` and every block of ``H``, from their summaries."""
    r = (G.shape[1] - 2) // 2
    least, most = np.zeros((len(G), len(H))), np.full((len(G), len(H)), np.pi)
    for k in range(r):
        lo, hi = cosine_interval(G[:, None, 2 + k], G[:, None, 2 + r + k], H[None, :, 2 + k], H[None, :, 2 + r + k])
        np.maximum(least, lo, out=least)
        np.minimum(most, hi, out=most)
    least, most = np.clip(least - ANGLE_SLACK, 0, np.pi), np.clip(most + ANGLE_SLACK, 0, np.pi)
    small, big = G[:, None, 0] * H[None, :, 0], G[:, None, 1] * H[None, :, 1]
    top, low = np.cos(least), np.cos(most)
    slack = big * 1e-9 + 1e-3
    return _long(np.where(low > 0, small, big) * low - slack), _long(np.where(top > 0, big, small) * top + slack)


def _references(P: DataFrame) -> dict[int, np.ndarray]:
    """Reference directions by vector length, from a bounded sample in hash order."""
    width = P.agg(F.max(F.size("v"))).first()[0]
    if not width or width < 1:
        return {}
    rows = max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    taken = P.orderBy(F.xxhash64("n", "v")).limit(rows).select("v").toArrow()
    return {d: pick_references(codes(M)) for d, _, M in matrix_groups(taken.column("v"))}


def codes(M: np.ndarray) -> np.ndarray:
    """Components x as floor(256 x), kept within +-2^63."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(M * SCALE), -2.0**63, 2.0**63)


def _coder(refs):
    """Rows of ``n, class, anchor, v`` to codes, norm and angles; ``near`` is the closest direction."""
    def code(it):
        for b in it:
            for d, at, M in matrix_groups(b.column(3)):
                C = codes(M)
                norm, ang = angles_to(C, refs.get(d, np.zeros((0, d))))
                near = ang.argmin(axis=1) if ang.shape[1] else np.zeros(len(at), int)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    *[b.column(k).take(take) for k in range(3)], pa.array(np.full(len(at), d, np.int32)), pa.array(near.astype(np.int32)),
                    pa.array([c.tobytes() for c in C], pa.binary()), pa.array(norm), pa.array([x.tobytes() for x in ang], pa.binary()),
                ], ["n", "class", "anchor", "d", "near", "code", "norm", "angle"])
    return code


def _packer(rows: int):
    """Consecutive rows of one class and length as blocks of at most ``rows``."""
    def pack(it):
        schema = pa.schema([("d", pa.int32()), ("class", pa.string()), *[(n, pa.binary()) for n in ("ids", "codes", "norms", "angles", "summary")]])
        held: list = []

        def flush():
            d, c = held[0][:2]
            norms, ang = np.array([h[4] for h in held]), np.frombuffer(b"".join(h[5] for h in held), np.float32).reshape(len(held), -1)
            out = (d, c, np.array([h[2] for h in held], np.int64).tobytes(), b"".join(h[3] for h in held), norms.tobytes(), ang.tobytes(), _summary(norms, ang).tobytes())
            held.clear()
            return out

        def out():
            for b in it:
                for r in zip(*[b.column(b.schema.get_field_index(x)).to_pylist() for x in ("d", "class", "n", "code", "norm", "angle")]):
                    if held and (held[0][:2] != r[:2] or len(held) >= rows):
                        yield flush()
                    held.append(r)
            if held:
                yield flush()

        yield from batches(schema, out(), 4)
    return pack


def _blocks(coded: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of like rows: ranges of class, length, closest direction and id, so a hot class is many ranges."""
    n = max(1, -(-coded.count() // (4 * rows)))
    order = ["class", "d", "near", "n"]
    spread = coded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    packed = spread.mapInArrow(_packer(rows), "d int, class string, ids binary, codes binary, norms binary, angles binary, summary binary")
    return stage(packed.select(F.monotonically_increasing_id().alias("b"), "*"), name)


def _products(A: np.ndarray, X: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows ``A[i]`` and ``X[x]``; one beyond a long is the nearest long."""
    out = np.empty(len(i), np.int64)
    bound = float(np.abs(A).max(initial=0)) * float(np.abs(X).max(initial=0)) * A.shape[1]
    if bound < 2**53:
        r, i_ = np.unique(i, return_inverse=True)
        c, x_ = np.unique(x, return_inverse=True)
        if len(i) * 8 > len(r) * len(c):  # most of what these rows and columns span
            return (A[r] @ X[c].T)[i_, x_].astype(np.int64)
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        if kind is object:
            whole = [sum(int(u) * int(v) for u, v in zip(p, q)) for p, q in zip(A[i[b]].tolist(), X[x[b]].tolist())]
            out[b] = [max(LOW, min(HIGH, s)) for s in whole]
        else:
            out[b] = np.einsum("ij,ij->i", A[i[b]].astype(kind), X[x[b]].astype(kind))
    return out


class Windows:
    """The best ``k`` so far within each score window ``(pos, slot, low, high)`` of the anchors of one block."""

    def __init__(self, ids, C, norms, angles, windows, k: int):
        self.ids, self.C, self.norms, self.angles, self.k = ids, C, norms, angles, k
        self.pos, self.slot, self.low, self.high = (windows[np.argsort(windows[:, 0], kind="stable"), c].copy() for c in range(4))
        self.first = np.searchsorted(self.pos, np.arange(len(ids) + 1))
        self.w = self.x = self.s = np.zeros(0, np.int64)
        self.scored = 0

    def bounds(self, rows, norms, angles):
        least = np.zeros((len(rows), len(norms)), np.float32)
        most = np.full((len(rows), len(norms)), np.float32(np.pi))
        for r in range(angles.shape[1]):
            a, x = self.angles[rows, r][:, None], angles[None, :, r]
            lo, hi = cosine_interval(a, a, x, x)
            np.maximum(least, lo, out=least)
            np.minimum(most, hi, out=most)
        return score_bounds(self.norms[rows][:, None], norms[None, :], least, most)

    def offer(self, ids, C, norms, angles) -> None:
        """Take in a block: angle intervals first, integer scores where one overlaps a window."""
        n = len(self.ids)
        hull = np.full(n, HIGH), np.full(n, LOW)
        np.minimum.at(hull[0], self.pos, self.low)
        np.maximum.at(hull[1], self.pos, self.high)
        some = np.flatnonzero(hull[0] <= hull[1])
        for a in range(0, len(some), 128):
            rows = some[a:a + 128]
            lo, hi = self.bounds(rows, norms, angles)
            i, x = np.nonzero((hi >= hull[0][rows][:, None]) & (lo <= hull[1][rows][:, None]))
            lo, hi, i = lo[i, x], hi[i, x], rows[i]
            own = self.ids[i] != ids[x]
            self._take(i[own], x[own], lo[own], hi[own], ids, C)
        self._trim()

    def _take(self, i, x, lo, hi, ids, C):
        many = self.first[i + 1] - self.first[i]
        pair = np.repeat(np.arange(len(i)), many)
        w = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[i], many)
        met = (hi[pair] >= self.low[w]) & (lo[pair] <= self.high[w])
        pair, w = pair[met], w[met]
        use, at = np.unique(pair, return_inverse=True)
        self.scored += len(use)
        if not len(use):
            return
        s = _products(self.C, C, i[use], x[use])[at]
        inside = (s >= self.low[w]) & (s <= self.high[w])
        self.w, self.x, self.s = np.r_[self.w, w[inside]], np.r_[self.x, ids[x[pair[inside]]]], np.r_[self.s, s[inside]]
        if len(self.w) > 1 << 18:
            self._trim()

    def _trim(self):
        o = np.lexsort((self.x, ~self.s, self.w))
        self.w, self.x, self.s = self.w[o], self.x[o], self.s[o]
        keep = np.arange(len(o)) - np.searchsorted(self.w, self.w) < self.k
        self.w, self.x, self.s = self.w[keep], self.x[keep], self.s[keep]
        full, n = np.unique(self.w, return_counts=True)
        last = np.searchsorted(self.w, full, side="right") - 1
        done = n == self.k
        self.low[full[done]] = self.s[last[done]]


WINDOW = "struct<pos:bigint,slot:bigint,low:bigint,high:bigint>"


def _hull(G: DataFrame) -> DataFrame:
    """What any window of a block covers; blocks without windows go."""
    return G.where(F.size("windows") > 0).select(
        F.col("b").alias("g"), "d", "class", F.array_min(F.col("windows.low")).alias("low"), F.array_max(F.col("windows.high")).alias("high"), "summary")


def _route(G: DataFrame, H: DataFrame, same: bool) -> DataFrame:
    """Block pairs whose bounds overlap a window: ``g, h, low, high``.  Only summaries travel, packs of blocks at a time."""
    own = ["class"] if same else []
    left = _hull(G).select("*", F.struct("g", "class", "low", "high", "summary").alias("s"))
    right = H.select("d", "class", F.struct(F.col("b").alias("h"), "class", "summary").alias("s"))
    n, m = (max(1, -(-df.count() // PACK)) for df in (G, H))
    left = left.groupBy("d", *own, F.pmod(F.xxhash64("s.g"), F.lit(n)).alias("p")).agg(F.collect_list("s").alias("gs"))
    right = right.groupBy("d", *own, F.pmod(F.xxhash64("s.h"), F.lit(m)).alias("q")).agg(F.collect_list("s").alias("hs"))
    met = left.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))).join(right, ["d", *own, "q"]).select("gs", "hs")

    def route(it):
        for b in it:
            for gs, hs in zip(b.column(0), b.column(1)):
                gs, hs = gs.as_py(), hs.as_py()
                lo, hi = _block_bounds(*(np.array([np.frombuffer(x["summary"]) for x in side]) for side in (gs, hs)))
                low, high = (np.array([x[c] for x in gs], np.int64)[:, None] for c in ("low", "high"))
                keep = (hi >= low) & (lo <= high)
                if not same:
                    keep &= np.array([x["class"] for x in gs], object)[:, None] != np.array([x["class"] for x in hs], object)[None, :]
                i, j = np.nonzero(keep)
                g, h = np.array([x["g"] for x in gs], np.int64), np.array([x["h"] for x in hs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(h[j]), pa.array(lo[i, j]), pa.array(hi[i, j])], ["g", "h", "low", "high"])

    return met.mapInArrow(route, "g bigint, h bigint, low double, high double")


def _compare(G: DataFrame, H: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per window over the block pairs: ``g, pos, slot, anchor, n, score``; a task hands on k rows a window."""
    left = G.select(F.col("b").alias("g"), "d", F.col("ids").alias("gi"), F.col("codes").alias("gc"), F.col("norms").alias("gn"), F.col("angles").alias("ga"), "windows")
    right = H.select(F.col("b").alias("h"), "ids", "codes", "norms", "angles")
    met = pairs.select("g", "h").join(left, "g").join(right, "h").drop("h")

    def search(it):
        schema = pa.schema([(c, pa.int64()) for c in ("g", "pos", "slot", "anchor", "n", "score")])
        best: dict = {}

        def done():
            for g, b in best.items():
                yield from zip([g] * len(b.w), b.pos[b.w].tolist(), b.slot[b.w].tolist(), b.ids[b.pos[b.w]].tolist(), b.x.tolist(), b.s.tolist())
            best.clear()

        def block(r, names, d):
            ids, C, norms = unpack(r[names[0]], np.int64), unpack(r[names[1]], np.float64, d), unpack(r[names[2]], np.float64)
            return ids, C, norms, np.frombuffer(r[names[3]], np.float32).reshape(len(ids), -1)

        def rows():
            for batch in it:
                for at in range(len(batch)):
                    r = {c: batch.column(j)[at].as_py() for j, c in enumerate(batch.schema.names)}
                    if r["g"] not in best:
                        if len(best) >= 16:
                            yield from done()
                        w = np.array([[x["pos"], x["slot"], x["low"], x["high"]] for x in r["windows"]], np.int64).reshape(-1, 4)
                        best[r["g"]] = Windows(*block(r, ("gi", "gc", "gn", "ga"), r["d"]), w, k)
                    best[r["g"]].offer(*block(r, ("ids", "codes", "norms", "angles"), r["d"]))
            yield from done()

        yield from batches(schema, rows(), 20_000)

    found = met.mapInArrow(search, "g bigint, pos bigint, slot bigint, anchor bigint, n bigint, score bigint")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("g", "pos", "slot").orderBy(F.col("score").desc(), "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(G: DataFrame, H: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """The best ``k`` per window of ``G`` among the rows of ``H`` of the same class, or of other classes.

    Every block meets the block with the largest bound first; the k-th best found raises
    the windows' lower ends, and only pairs that still overlap one are compared then.
    """
    pairs = stage(_route(G, H, same), f"{name}_pairs")
    home = pairs.groupBy("g").agg(F.max(F.struct("high", "h"))["h"].alias("h"))
    begun = stage(_compare(G, H, home, k), f"{name}_begun")
    full = begun.where(F.col("rank") == k).groupBy("g").agg(F.map_from_entries(F.collect_list(
        F.struct(F.struct("pos", "slot"), "score"))).alias("least"))
    raised = F.transform("windows", lambda x: F.struct(x["pos"].alias("pos"), x["slot"].alias("slot"), F.greatest(
        x["low"], F.element_at("least", F.struct(x["pos"].alias("pos"), x["slot"].alias("slot")))).alias("low"), x["high"].alias("high")))
    G2 = G.join(full.withColumnRenamed("g", "b"), "b", "left").withColumn("windows", F.when(F.col("least").isNull(), F.col("windows")).otherwise(raised)).drop("least")
    hull = _hull(G2).select("g", F.col("low").alias("need"))
    rest = pairs.join(home.select("g", "h"), ["g", "h"], "left_anti").join(hull, "g").where("high >= need")
    more = stage(_compare(G2, H, rest, k), f"{name}_more")
    return stage(_first(begun.drop("rank").unionByName(more.drop("rank")), k), name)


def hard_negatives(patches: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   key: Sequence[str] = ("slide", "patch_id"), label: str = "class_id", vec: str = "vec",
                   anchor_rows: int = 256, block: int = 2048) -> DataFrame:
    """Patches of other classes that score nearly as high as an anchor's best matches.

    patches   rows of ``slide, patch_id, class_id, vec``, or any ``key`` columns, ``label`` and ``vec``
    anchor    condition that says which patches are anchors

    A score is the inner product of two vectors, every component x as floor(256 x).  An
    anchor's positives are its ``positives`` best rows of the same class (all, if fewer).  For
    each, the ``negatives`` best rows of other classes with low * positive_score <= 100 *
    negative_score <= high * positive_score.  Ties go to the smaller key, column by column.

    Returns ``anchor_*, positive_*, negative_*`` for every key column, then ``rank``,
    ``positive_score, negative_score``.  An anchor or positive without negatives has no row.

    Exact.  Every patch stores its norm and its angles to a few directions picked from a
    bounded sample (SAMPLE_ROWS rows); the difference and the sum of two patches' angles
    bound the angle between them, and with the norms their score.  Patches lie in blocks of
    like ones; pairs of blocks are routed by the bounds of whole blocks, pairs of patches
    get an integer score only where their own bounds overlap a window.

    Rows with a null key column, a null class, a vector that is null or empty or holds null
    or non-finite components take no part, and vectors of different lengths do not meet.
    Rows that repeat a key are rows of their own that do not meet each other; a repeated
    anchor gets its negatives once for each.  Components beyond +-2^63 / 256 and scores
    beyond a long count as the nearest.  Empty tables give an empty result; other columns
    do not matter.
    """
    kinds = dict(patches.dtypes)
    plain = len(key) == 1 and kinds[key[0]] in ("tinyint", "smallint", "int", "bigint")
    v = F.col(vec) if kinds[vec] in ("array<float>", "array<double>") else F.col(vec).cast("array<double>")
    P = patches.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col(label).cast("string").alias("class"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v")).dropna(subset=[*[f"k{i}" for i in range(len(key))], "class", "v"])
    names = [f"k{i}" for i in range(len(key))]
    if plain:
        P = P.select(F.col("k0").cast("long").alias("n"), "class", "anchor", "v")
    else:
        # Numbers in key order: ranges of keys, sorted, numbered by range and row.
        numbers = stage(P.select(*names).distinct().repartitionByRange(*names).sortWithinPartitions(*names).select(
            F.monotonically_increasing_id().alias("n"), "*"), "keys")
        P = P.join(numbers, names).select("n", "class", "anchor", "v")
    refs = _references(P)
    coded = stage(P.mapInArrow(_coder(refs), "n bigint, class string, anchor boolean, d int, near int, code binary, norm double, angle binary"), "coded")
    H = _blocks(coded, block, "patches")
    A = _blocks(coded.where("anchor"), anchor_rows, "anchors")

    every = F.transform(F.sequence(F.lit(0).cast("bigint"), (F.octet_length("ids") / 8 - 1).cast("bigint")), lambda i: F.struct(
        i.alias("pos"), F.lit(0).cast("bigint").alias("slot"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high")))
    near = _search(A.withColumn("windows", every), H, True, positives, "positives")

    score = F.col("score").cast("decimal(38,0)")
    ends = near.select("g", "pos", F.col("rank").cast("bigint").alias("slot"), F.ceil(score * low / 100).alias("a"), F.floor(score * high / 100).alias("z")).where("a <= z")
    some = lambda c: F.greatest(F.lit(LOW).cast("decimal(38,0)"), F.least(F.lit(HIGH).cast("decimal(38,0)"), F.col(c))).cast("bigint")
    windows = ends.groupBy(F.col("g").alias("b")).agg(F.collect_list(F.struct("pos", "slot", some("a").alias("low"), some("z").alias("high"))).alias("windows"))
    far = _search(A.join(windows, "b"), H, False, negatives, "negatives")

    out = far.join(near.select("g", "pos", F.col("rank").cast("bigint").alias("slot"), F.col("n").alias("positive"), F.col("score").alias("positive_score")), ["g", "pos", "slot"])
    out = out.select("anchor", "positive", F.col("n").alias("negative"), "rank", "positive_score", F.col("score").alias("negative_score"))
    for role in ("anchor", "positive", "negative"):
        if plain:
            out = out.withColumnRenamed(role, f"{role}_{key[0]}")
        else:
            named = numbers.select(F.col("n").alias(role), *[F.col(f"k{i}").alias(f"{role}_{c}") for i, c in enumerate(key)])
            out = out.join(named, role).drop(role)
    return out.select(*[f"{role}_{c}" for role in ("anchor", "positive", "negative") for c in key], "rank", "positive_score", "negative_score")
