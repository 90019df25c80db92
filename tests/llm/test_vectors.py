"""Vector and placement operators against brute force, and the registered queries as a whole."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchframe.llm import forest, shards, topk
from patchframe.llm.union import components, local_roots

VECS = "patch_id long, vec array<double>, id string, v int, d int"


def patches(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], VECS)


# --- top-k ----------------------------------------------------------------------------------

def plain_top(queries, rows, k):
    ok = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ok:
            s = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64])
def test_nearest_patches_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 20))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=20)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 20), (504, [1.0, 2.0]), (505, [3.0, -1.0]), (None, [1.0] * 20), (506, [float("inf")] * 20), (507, [0.0] * 20)]
    df = patches(spark, rows)
    got = topk.nearest_patches(df.where("patch_id % 10 = 0 OR patch_id IN (504, 507)"), df, 5, block=block)
    assert sorted(map(tuple, got.collect())) == plain_top([i for i, _ in rows if i is not None and (i % 10 == 0 or i in (504, 507))], rows, 5)
    assert topk.nearest_patches(df.limit(0), df).count() == 0 and topk.nearest_patches(df, df.limit(0)).count() == 0


def test_exploded_blocks_are_not_broadcast(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = patches(spark, rows)
    got = topk.nearest_patches(df.where("patch_id % 10 = 0"), df, 2, block=4)
    assert sorted(map(tuple, got.collect())) == plain_top(range(0, 60, 10), rows, 2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # as it was run


def test_nearest_of_very_large_numbers_stays_exact(spark):
    rows = [(i, [2.0**22 + i, -(2.0**22), float(i % 3)]) for i in range(20)]
    df = patches(spark, rows)
    assert sorted(map(tuple, topk.nearest_patches(df, df, 3).collect())) == plain_top(range(20), rows, 3)


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    X = np.floor(256 * rng.normal(size=(200, 37)))
    for s in topk.LEVELS:
        S = topk.segment_stats(X, s)
        assert (S @ S.T >= X @ X.T - 1e-6).all()


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    X = np.floor(256 * np.sort(rng.normal(size=(3000, 16)), axis=1) * rng.uniform(0.1, 3, (3000, 1)))
    best = topk._Best(np.arange(20), X[:20], 5)
    for a in range(0, 3000, 250):
        best.offer(np.arange(a, a + 250), X[a:a + 250])
    for q in range(20):
        s = sorted((-int(X[q] @ X[i]), i) for i in range(3000) if i != q)[:5]
        assert [(-a, b) for a, b in zip(best.s[best.q == q].tolist(), best.x[best.q == q].tolist())] == s


# --- near duplicates --------------------------------------------------------------------------

def plain_near(rows, threshold):
    ok = [(i, np.array(v, float) / np.abs(v).max()) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = collections.Counter(), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(ok):
        for j, y in ok[a + 1:]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("leaf,block", [(512, 2048), (40, 16)])
def test_near_duplicates_against_all_pairs(spark, leaf, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(150):
        base = rng.normal(size=24)
        for _ in range(60 if g == 0 else rng.integers(1, 4)):
            rows.append((len(rows), (base + 0.25 * rng.normal(size=24) / np.sqrt(24) * np.linalg.norm(base) / 2).tolist()))
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [1e-200] + [0.0] * 23), (2007, [1.0] + [0.0] * 23)]
    got = {r.patch_id: r for r in forest.near_duplicate_patches(patches(spark, rows), leaf=leaf, block=block).collect()}
    want = plain_near(rows, 0.95)
    assert len(got) == len(rows)
    right = sum((got[i].n_links, got[i].component_id) == want[i] for i in want)
    assert all(got[i].n_links <= want[i][0] and got[i].kept == (got[i].component_id == i) for i in want)
    assert right >= 0.97 * len(want) and sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    df = patches(spark, [(3, [1, 2]), (3, [1, 2]), (None, [1, 2]), (8, [2, 4])])
    got = sorted((str(r.patch_id), r.n_links, str(r.component_id), r.kept) for r in forest.near_duplicate_patches(df).collect())
    assert got == [("3", 2, "3", True), ("3", 2, "3", True), ("8", 2, "3", False), ("None", 0, "None", True)]
    assert forest.near_duplicate_patches(df.limit(0)).count() == 0


def test_near_duplicates_of_lengths_without_trees(spark, monkeypatch):
    monkeypatch.setattr(forest, "LENGTHS", 1)
    rows = [(10 * d + i, [1.0] * (d - 1) + [1.0 + i / 100]) for d in range(2, 8) for i in range(3)]
    got = {r.patch_id: (r.n_links, r.component_id) for r in forest.near_duplicate_patches(patches(spark, rows)).collect()}
    assert got == {i: (2, i // 10 * 10) for i, _ in rows}


# --- components -------------------------------------------------------------------------------

def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(None, 4), (7, 7), (5, None)]
    rng.shuffle(links)
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_roots(5, np.array([4, 1]), np.array([3, 4])).tolist() == [0, 1, 2, 1, 1]


# --- shards -----------------------------------------------------------------------------------

@pytest.mark.parametrize("n,hot,bucket", [(900, 300, 50_000), (37, 5, 50_000), (500, 490, 40), (0, 0, 10)])
def test_shards_are_even_and_keep_links_together(spark, monkeypatch, n, hot, bucket):
    monkeypatch.setattr(shards, "BUCKET", bucket)
    rng = random.Random(9)
    rows = [(i, "hot" if i < hot else f"g{rng.randrange(max(1, n // 3))}" if i % 4 == 0 else None if i % 4 == 1 else f"own{i}", 5, "x") for i in range(n)]
    rows = [*rows[:-2], (None, None, 5, "x"), rows[3]] if n else rows
    df = spark.createDataFrame(rows, "slide long, twin string, shard int, n string")
    got = shards.place_linked(df, 10, keep=["twin", "n"]).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    size = [len(by[s]) for s in range(10)]
    assert max(size) - min(size) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    groups = collections.defaultdict(set)
    for r in got:
        if r.twin:
            groups[r.twin].add(r.shard)
    if n == 900:
        small = [g for g in groups if g != "hot"]
        assert sum(len(groups[g]) == 1 for g in small) >= 0.9 * len(small)
    if hot:
        assert len(groups["hot"]) <= 2 * (hot // max(1, n // 10)) + 2


def test_shards_move_parts_until_none_is_granted(spark, monkeypatch):
    left, real = [], shards.stage

    def stage(df, name):
        out = real(df, name)
        if name in ("asks", "granted"):
            left.append(out.count())
        return out

    monkeypatch.setattr(shards, "stage", stage)
    df = spark.createDataFrame([(i, f"g{i // 3}") for i in range(1800)], "slide long, twin string")
    assert shards.place_linked(df, 30).count() == 1800
    assert left[-1] == 0


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET", 7)
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("k"))
    got = shards.running(df, ["k"], [F.col("id")], F.col("id"), 100).collect()
    for k in (None, 1, 2, 3, 4):
        own = sorted((r.before, r.id) for r in got if r.k == k)
        assert own[0][0] == 0 and all(b == a + i for (a, i), (b, _) in zip(own, own[1:]) if i) and len(own) == 20
