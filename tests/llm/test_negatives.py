"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchframe.llm import negatives

PATCHES = "slide string, patch_id long, class_id string, vec array<double>, n int, rank string, v int"


def patches(spark, rows):
    return spark.createDataFrame([(s, i, c, None if v is None else [None if x is None else float(x) for x in v], 1, "r", 2) for s, i, c, v in rows], PATCHES)


def plain_negatives(rows, anchor, positives=5, k=5, low=80, high=100):
    ok = [(key, c, [int(np.floor(256 * np.float64(x))) for x in v]) for *key, c, v in rows
          if None not in key and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(tuple(key), c, v) for key, c, v in ok]
    out = []
    for a, c, v in ok:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), key, d == c) for key, d, w in ok if key != a and len(w) == len(v))
        best = [(key, -s) for s, key, same in scored if same][:positives]
        for p, ps in best:
            fit = [(key, -s) for s, key, same in scored if not same and low * ps <= -100 * s <= high * ps][:k]
            out += [(*a, *p, *key, r + 1, ps, s) for r, (key, s) in enumerate(fit)]
    return sorted(out)


def sample(seed, n, d, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(f"s{i % 2}", i // 2, f"c{rng.integers(4)}", (centres[i % groups] + 0.3 * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block,anchor_rows,d", [(9, 3, 12), (64, 16, 5), (2048, 256, 30)])
def test_against_brute_force(spark, block, anchor_rows, d):
    rows = sample(block, 260, d, 6)
    rows += [("s0", 500 + i, f"c{i % 3}", rows[i][3]) for i in range(20)]  # ties
    rows += [("s0", 700, None, [1.0] * d), ("s0", 701, "c1", None), ("s0", 702, "c1", []), ("s1", 703, "c1", [float("nan")] * d), ("s1", 704, "c1", [None] * d),
             ("s1", 705, "c1", [float("inf")] * d), ("s1", 706, "c1", [1.0, 2.0]), ("s0", 707, "c2", [1.5, 2.0]), ("s0", 709, "c1", [0.5, 2.5]), ("s0", 708, "c1", [0.0] * d),
             (None, 5, "c1", [1.0] * d), ("s0", None, "c1", [1.0] * d), ("s0", 711, "lonely", [1.0] * d)]
    df = patches(spark, rows)
    got = negatives.hard_negatives(df, F.expr("patch_id % 10 = 0 OR patch_id > 700"), block=block, anchor_rows=anchor_rows)
    assert got.columns == ["anchor_slide", "anchor_patch_id", "positive_slide", "positive_patch_id", "negative_slide", "negative_patch_id", "rank", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda a: a[1] % 10 == 0 or a[1] > 700)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_windows_counts_and_a_hot_class(spark):
    rows = [(s, i, "hot" if i % 3 else c, v) for s, i, c, v in sample(2, 300, 6, 3)]
    got = negatives.hard_negatives(patches(spark, rows), F.col("patch_id") < 9, 3, 2, 50, 90, block=16, anchor_rows=4)
    want = plain_negatives(rows, lambda a: a[1] < 9, 3, 2, 50, 90)
    assert sorted(map(tuple, got.collect())) == want and want


def test_single_key_and_repeated_rows(spark):
    rows = [("s", i // 2 if i < 8 else i, f"c{i % 3}", [1.0 + i % 5, 2.0, float(i % 4)]) for i in range(40)]
    got = negatives.hard_negatives(patches(spark, rows), F.col("patch_id") % 2 == 0, key=["patch_id"])
    want = plain_negatives([(i, c, v) for _, i, c, v in rows], lambda a: a[0] % 2 == 0)
    assert got.columns[:3] == ["anchor_patch_id", "positive_patch_id", "negative_patch_id"]
    # A repeated anchor is mined once for each of its rows.
    assert sorted(map(tuple, got.collect())) == want


def test_nothing(spark):
    df = patches(spark, sample(1, 20, 3, 2))
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_very_large_numbers(spark):
    rows = [("s", i, f"c{i % 2}", [2.0**30 + i, -(2.0**30) + 3, float(i % 3)]) for i in range(24)]
    got = negatives.hard_negatives(patches(spark, rows), F.col("patch_id") < 4)
    want = plain_negatives(rows, lambda a: a[1] < 4)
    clip = lambda r: (*r[:7], *(min(x, 2**63 - 1) for x in r[7:]))
    assert len(want) and all(max(r[7:]) >= 2**63 for r in want)
    # All scores are beyond a long and count as the largest one, so ids alone decide.
    assert {clip(r)[7:] for r in map(tuple, got.collect())} == {(2**63 - 1, 2**63 - 1)}
    small = [(s, i, c, [x / 256 for x in v]) for s, i, c, v in rows]
    got = negatives.hard_negatives(patches(spark, small), F.col("patch_id") < 4)
    assert sorted(map(tuple, got.collect())) == plain_negatives(small, lambda a: a[1] < 4)


def test_bounds_hold_for_pairs_and_blocks():
    rng = np.random.default_rng(0)
    X = np.floor(256 * rng.normal(size=(300, 20)) * rng.uniform(0, 3, (300, 1)))
    X = np.vstack([X, X[:5], -X[:5], np.zeros((1, 20))])
    R = negatives.pick_references(X)
    assert len(R) == negatives.REFERENCES
    norm, ang = negatives.angles_to(X, R)
    S = X @ X.T
    lo, hi = np.zeros(S.shape), np.zeros(S.shape)
    w = negatives.Windows(np.arange(len(X)), X, norm, ang, np.zeros((0, 4), np.int64), 1)
    lo, hi = w.bounds(np.arange(len(X)), norm, ang)
    assert (lo <= S).all() and (S <= hi).all()
    blocks = np.array_split(np.argsort(ang.argmin(axis=1), kind="stable"), 40)
    G = np.array([negatives._summary(norm[b], ang[b]) for b in blocks])
    lo, hi = negatives._block_bounds(G, G)
    for i, a in enumerate(blocks):
        for j, b in enumerate(blocks):
            assert lo[i, j] <= S[np.ix_(a, b)].min() and S[np.ix_(a, b)].max() <= hi[i, j]


def test_windows_score_only_what_overlaps():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    X = np.floor(256 * (centres[np.arange(4000) % 8] + 0.1 * rng.normal(size=(4000, 32))))
    norm, ang = negatives.angles_to(X, negatives.pick_references(X))
    low = np.array([int(0.9 * (X[i] @ X[i + 8])) for i in range(16)])
    win = np.c_[np.arange(16), np.zeros(16, int), low, np.full(16, 2**63 - 1)].astype(np.int64)
    w = negatives.Windows(np.arange(16), X[:16], norm[:16], ang[:16], win, 5)
    for a in range(0, 4000, 500):
        b = slice(a, a + 500)
        w.offer(np.arange(a, a + 500), X[b], norm[b], ang[b])
    assert w.scored < 0.2 * 16 * 4000
    for i in range(16):
        s = sorted((-int(X[i] @ X[j]), j) for j in range(4000) if j != i and X[i] @ X[j] >= low[i])[:5]
        assert list(zip((-w.s[w.w == i]).tolist(), w.x[w.w == i].tolist())) == s
