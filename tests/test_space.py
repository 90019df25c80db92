import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchframe.functions import geometry as geo
from patchframe.functions import scalar
from patchframe.operators import components as cc
from patchframe.operators import contour, grid, joins, lattice, raster, tissue


def mask_df(spark, m, slide="s"):
    rows = [(slide, x, y, int(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "slide string, x int, y int, m int")


def to_array(df, shape, column="m"):
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def poly(*rings):
    return [[[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]]


REGION = "slide string, id string, geom_type string, polygons " + geo.GEOMETRY_TYPE


def flood(m):
    lab, out = 0, np.full(m.shape, -1)
    sizes = []
    for y, x in zip(*np.nonzero(m)):
        if out[y, x] >= 0:
            continue
        stack, n = [(y, x)], 0
        out[y, x] = lab
        while stack:
            a, b = stack.pop()
            n += 1
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and out[c, d] < 0:
                    out[c, d] = lab
                    stack.append((c, d))
        sizes.append(n)
        lab += 1
    return out, sizes


@pytest.mark.parametrize("tile", [5, 64])
def test_components_match_flood_fill(spark, tile):
    rng = np.random.default_rng(tile)
    m = rng.random((23, 31)) < 0.55
    stats = cc.component_stats(cc.label_components(mask_df(spark, m), tile=tile)).collect()
    _, sizes = flood(m)
    assert sorted(r["cells"] for r in stats) == sorted(sizes)


def test_a_spiral_is_one_component_across_tiles(spark):
    m = np.zeros((15, 15), int)
    for k in range(0, 7, 2):
        m[k, k : 15 - k] = 1
        m[k : 15 - k, 14 - k] = 1
        m[14 - k, k + 2 : 15 - k] = 1
        if k:
            m[k : 15 - k, k - 2 + 2] = 1
    got = cc.component_stats(cc.label_components(mask_df(spark, m), tile=4)).collect()
    assert sorted(r["cells"] for r in got) == sorted(flood(m)[1])


def test_cells_are_written_twice_whatever_the_shape(spark, monkeypatch):
    """A snake through many tiles: packed tiles and the result are all that holds every cell, and stages go."""
    m = np.zeros((9, 12), int)
    m[::2] = 1
    m[1::4, 11] = 1
    m[3::4, 0] = 1
    sizes, made, real, gone = [], [], cc.cut_lineage, cc.drop_stage

    def cut(df):
        out = real(df)
        sizes.append(sum(len(r["pos"]) // 4 for r in out.select("pos").collect()) if "pos" in out.columns else out.count())
        made.append(out)
        return out

    monkeypatch.setattr(cc, "cut_lineage", cut)
    L = cc.label_components(mask_df(spark, m), 6)
    assert L.select("label").distinct().count() == 1 and L.count() == m.sum()
    assert sum(n == m.sum() for n in sizes) == 2
    sizes.clear()
    seeds = mask_df(spark, m).filter("x = 0 AND y = 0").select("slide", "x", "y", F.lit(0).cast("bigint").alias("label"))
    grown = cc.hysteresis_grow(seeds, mask_df(spark, m), 6)
    assert grown.count() == m.sum() and sum(n == m.sum() for n in sizes) == 2
    left = [d for d in made if os.path.exists(d.stage_path)]
    assert len(left) == 2


@pytest.mark.parametrize("tile", [4, 16])
def test_growth_equals_rings(spark, tile):
    rng = np.random.default_rng(tile)
    weak = (rng.random((30, 34)) < 0.72).astype(int)
    seeds = [(int(y), int(x)) for y, x in zip(*np.nonzero(weak)) if rng.random() < 0.01]
    label = np.full(weak.shape, 1 << 30)
    for k, (y, x) in enumerate(seeds):
        label[y, x] = k
    front = list(seeds)
    while front:
        reached = {}
        for y, x in front:
            for a, c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < 30 and 0 <= c < 34 and weak[a, c] and label[a, c] == 1 << 30:
                    reached[a, c] = min(reached.get((a, c), 1 << 30), label[y, x])
        for at, k in reached.items():
            label[at] = k
        front = list(reached)
    s = spark.createDataFrame([("s", x, y, k) for k, (y, x) in enumerate(seeds)], "slide string, x int, y int, label long")
    got = {(r["y"], r["x"]): r["label"] for r in cc.hysteresis_grow(s, mask_df(spark, weak), tile).collect()}
    assert got == {(y, x): int(label[y, x]) for y, x in zip(*np.nonzero(label < 1 << 30))}


@pytest.mark.parametrize("tile", [4, 64])
def test_growth_keeps_fragments_apart(spark, tile):
    m = np.zeros((9, 21), int)
    m[4, 2], m[4, 17] = 1, 1
    weak = np.ones_like(m)
    weak[:, 0] = 0
    seeds = cc.label_components(mask_df(spark, m), tile)
    got = to_array(cc.hysteresis_grow(seeds, mask_df(spark, weak), tile), m.shape, "label")
    left, right = 4 * (1 << 20) + 2, 4 * (1 << 20) + 17
    # Cell 9 is seven from one seed and eight from the other; row 4 splits there.
    assert (got[:, 1:10] == left).all() and (got[:, 10:] == right).all() and (got[:, 0] == 0).all()


def test_holes_are_filled_by_size_and_not_at_the_border(spark):
    m = np.ones((12, 14), int)
    m[3, 3] = 0
    m[6:9, 6:9] = 0
    m[0, 10] = 0
    got = to_array(cc.fill_holes(mask_df(spark, m), 4, tile=5), m.shape)
    want = m.copy()
    want[3, 3] = 1
    assert (got == want).all()


def brute(m, r, fn):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = fn(m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1])
    return out


def test_morphology_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    m = (rng.random((17, 13)) < 0.7).astype(int)
    opened = brute(brute(m, 1, np.min), 1, np.max)
    both = brute(brute(opened, 2, np.max), 2, np.min)
    got = raster.sweeps(mask_df(spark, m), ["m"], [("erode", 1), ("dilate", 1), ("dilate", 2), ("erode", 2)])
    assert (to_array(got, m.shape) == both).all()
    assert (to_array(raster.opening(mask_df(spark, m), 1), m.shape) == opened).all()


def meets(rings):
    """Do any two segments meet elsewhere than in a common end?  Plain loops."""
    segs = [(tuple(r[k]), tuple(r[k + 1])) for r in rings for k in range(len(r) - 1)]

    def side(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def on(a, b, c):
        return side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    for i, (a, b) in enumerate(segs):
        for c, d in segs[i + 1:]:
            if {a, b} == {c, d} or any(on(a, b, e) for e in (c, d) if e not in (a, b)) or any(on(c, d, e) for e in (a, b) if e not in (c, d)):
                return True
            if not {a, b} & {c, d} and side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def outline_segments(m):
    m, table, out = np.pad(m, 1), contour._segments(), []
    for y in range(m.shape[0] - 1):
        for x in range(m.shape[1] - 1):
            code = 8 * m[y, x] + 4 * m[y, x + 1] + 2 * m[y + 1, x + 1] + m[y + 1, x]
            out += [(2 * x + a, 2 * y + b, 2 * x + c, 2 * y + d) for a, b, c, d in table.get(int(code), [])]
    return np.array(out)


def test_simplified_rings_stay_simple():
    crossed = 0
    rng = np.random.default_rng(2)
    for k in range(25):
        m = np.zeros((22, 22), int)
        y, x = 11, 11
        for _ in range(170):  # a winding walk, thin in places
            m[y, x] = 1
            dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][rng.integers(4)]
            y, x = np.clip(y + dy, 1, 20), np.clip(x + dx, 1, 20)
        raw = contour.link_rings(outline_segments(m))
        assert not meets(raw)
        for tolerance in (0.8, 1.5, 3.0):
            got = contour.simplify_rings(raw, tolerance)
            assert not meets(got), (k, tolerance)
            assert sum(map(len, got)) < sum(map(len, raw))
            crossed += meets([r[contour._kept(r, tolerance)] for r in raw])
    assert crossed > 3  # without the check these would cross


def test_outline_of_a_ring_of_cells(spark):
    m = np.zeros((9, 9), int)
    m[1:8, 1:8] = 1
    m[3:6, 3:6] = 0
    m[0, 8] = 1
    L = cc.label_components(mask_df(spark, m))
    t = contour.trace_regions(L, ["slide", "label"], 1.0, 0.0).collect()
    assert len(t) == 1 and t[0]["n_rings"] == 2
    # Corners are cut by half a cell's corner: 49 - 4/8 and 9 + 4/8 the other way.
    assert t[0]["ring_area"] == pytest.approx(49 - 0.5)
    assert (t[0]["minx"], t[0]["maxx"]) == (0.5, 7.5)
    coarse = contour.trace_regions(L, ["slide", "label"], 1.0, 0.8).first()
    assert len(coarse["rings"][0]) < len(t[0]["rings"][0])


def test_holes_go_to_their_own_outline(spark):
    m = np.zeros((14, 24), int)
    m[1:12, 1:12] = 1
    m[3:10, 3:10] = 0
    m[5:8, 5:8] = 1  # an island in the hole, with a hole of its own
    m[6, 6] = 0
    m[1:8, 14:22] = 1
    m[3, 16] = m[5, 18:20] = 0
    # One group for all cells, so it has several outlines.
    t = contour.trace_regions(mask_df(spark, m).filter("m = 1").withColumn("label", F.lit(1)), ["slide", "label"], 0.0, 0.0).collect()
    got = sorted((r["minx"], r["maxx"], r["n_rings"]) for r in t)
    assert got == [(0.5, 11.5, 2), (4.5, 7.5, 2), (13.5, 21.5, 3)]


def painted(spark, w=160, h=120):
    a = np.full((h, w, 3), 240, int)
    a += np.arange(w * h).reshape(h, w, 1) % 3
    a[15:55, 15:65] = (190, 110, 160)      # strong
    a[70:105, 20:60] = (224, 205, 218)     # faded
    a[30:36, 15:65] += 0
    a[:, 120:121] = (150, 150, 150)        # seam
    a[30:40, 30:40] = 241                  # lumen
    rows = [("p", x, y, *map(int, a[y, x])) for y in range(h) for x in range(w)]
    blank = [("blank", x, y, 240, 240, 240) for y in range(20) for x in range(20)]
    return spark.createDataFrame(rows + blank, "slide string, x int, y int, r int, g int, b int")


def test_detector_on_a_painted_slide(spark):
    C = painted(spark)
    slides = spark.createDataFrame(
        [("p", 0.0, 0.0, 1600.0, 1200.0, 1.0), ("blank", 0.0, 0.0, 200.0, 200.0, 1.0)],
        "slide string, ox double, oy double, span_x double, span_y double, mpp double")
    regions, cells, report = tissue.detect_tissue(C, slides, tile=50)
    rep = {r["slide"]: r for r in report.collect()}
    assert rep["blank"]["regions"] == 0 and rep["p"]["regions"] >= 1
    R = geo.with_bbox(regions).collect()
    strong = [r for r in R if r["minx"] < 200 and r["miny"] < 200]
    assert len(strong) == 1 and strong[0]["maxx"] == pytest.approx(645, abs=30)
    # The lumen (100 cells of 100 um2) is under the hole limit and filled; the seam is gone.
    assert len(strong[0]["polygons"][0]) == 1
    assert not [r for r in R if r["minx"] > 1100]


def test_one_colour_has_no_tissue(spark):
    C = spark.createDataFrame([("s", x, y, 9, 9, 9) for x in range(5) for y in range(5)], "slide string, x int, y int, r int, g int, b int")
    r = raster.otsu_levels(raster.tissue_score(C)).first()
    assert (r["relaxed"], r["weak"]) == (256, 256)


def test_features_against_direct_windows(spark):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 256, (9, 11, 3))
    C = spark.createDataFrame([("s", x, y, *map(int, a[y, x])) for y in range(9) for x in range(11)],
                              "slide string, x int, y int, r int, g int, b int")
    lum = a @ np.array([0.299, 0.587, 0.114])
    f = raster.cell_features(C).toPandas().set_index(["y", "x"]).sort_index()
    for y, x in ((0, 0), (4, 5), (8, 10), (3, 0)):
        near = lambda r: lum[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        assert f.loc[(y, x), "detailFine"] == pytest.approx(near(1).std(), abs=1e-6)
        assert f.loc[(y, x), "localRange"] == pytest.approx(2 * near(2).std(), abs=1e-6)
        assert f.loc[(y, x), "neighbourDarkness"] == pytest.approx(255 - near(4).mean())
        gx = lum[y, min(10, x + 1)] - lum[y, max(0, x - 1)]
        gy = lum[min(8, y + 1), x] - lum[max(0, y - 1), x]
        assert f.loc[(y, x), "gradient"] == pytest.approx(np.hypot(gx, gy))


def test_geometry_expressions(spark):
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    far = [(20, 20), (22, 20), (22, 22), (20, 22), (20, 20)]
    d = spark.createDataFrame([("s", "a", "Polygon", poly(square, hole)), ("s", "l", "LineString", poly([(0, 0), (3, 4)])),
                               ("s", "bad", "Polygon", poly([(0, 0), (1, 1), (0, 0)])),
                               ("s", "nan", "Polygon", poly([(0, 0), (float("nan"), 1), (1, 1), (0, 0)])),
                               ("s", "h", "Polygon", poly(square, hole, far))], REGION)
    r = {x["id"]: x for x in d.select(
        "id", geo.area("polygons", "geom_type").alias("area"), geo.contains_point("polygons", F.lit(3.0), F.lit(3.0)).alias("in_hole"),
        geo.contains_point("polygons", F.lit(5.0), F.lit(5.0)).alias("inside"),
        geo.is_degenerate("polygons", "geom_type").alias("bad"),
        geo.distance_to_geometry("polygons", F.lit(3.0), F.lit(0.0)).alias("d"),
        F.size(geo.valid_rings(F.col("polygons")[0])).alias("rings")).collect()}
    assert r["a"]["area"] == 96 and not r["a"]["in_hole"] and r["a"]["inside"] and not r["a"]["bad"]
    assert r["l"]["area"] == 0 and r["l"]["d"] == pytest.approx(2.4) and not r["l"]["bad"]
    assert r["bad"]["bad"] and r["nan"]["bad"]
    assert r["h"]["rings"] == 2 and r["a"]["rings"] == 2
    one = spark.range(1).select(
        F.size(geo.circle_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), 16)).alias("n"),
        geo.area(F.array(F.array(geo.rect_ring(F.lit(5.0), F.lit(5.0), F.lit(1.0), F.lit(2.0))))).alias("a"),
        scalar.half_up(F.lit(-2.5)).alias("h"), scalar.slug(F.lit("T cells / CD8+")).alias("s"),
        scalar.file_ext(F.lit("a/b.C.SVS")).alias("e")).first()
    assert one["n"] == 17 and one["a"] == 12 and one["h"] == -2 and one["s"] == "t-cells-cd8" and one["e"] == "svs"


@pytest.mark.parametrize("tile", [7.0, 4096.0])
def test_points_in_regions_match_a_plain_loop(spark, tile):
    rng = np.random.default_rng(6)
    ring = [(float(50 + 40 * np.cos(a) * (1 + 0.4 * np.sin(5 * a))), float(50 + 40 * np.sin(a))) for a in np.linspace(0, 2 * np.pi, 40)[:-1]]
    hole = [(45, 45), (60, 45), (60, 60), (45, 60)]
    R = spark.createDataFrame([("s", "a", "Polygon", poly(ring + ring[:1], hole + hole[:1])),
                               ("s", "line", "LineString", poly([(0, 0), (99, 99)]))], REGION)
    pts = rng.integers(0, 100, (400, 2))
    P = spark.createDataFrame([("s", i, int(x), int(y), 1) for i, (x, y) in enumerate(pts)], "slide string, patch_id bigint, x bigint, y bigint, side int")
    got = {r["patch_id"] for r in joins.patches_inside(P, R, tile=tile).collect()}

    def inside(x, y):
        c = False
        for r_ in (ring, hole):
            for (x1, y1), (x2, y2) in zip(r_, r_[1:] + r_[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    c = not c
        return c

    assert got == {i for i, (x, y) in enumerate(pts) if inside(x + 0.5, y + 0.5)}
    assert joins.filter_patches(P, None, R.filter("geom_type = 'LineString'")).count() == 400


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_cells_are_not_broadcast(spark):
    """The planner takes an exploded table to be as small as what it was exploded from."""
    slides = spark.range(3).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slide"))
    C = slides.select("slide", F.lit(1).alias("x"), F.lit(2).alias("y"), *[F.lit(9).alias(c) for c in "rgb"])
    full = raster.fill_missing(C, slides.withColumns({"w": F.lit(4), "h": F.lit(5)}))
    dark = full.filter("r < 220")  # makes an inner join of the outer one
    assert "Broadcast" not in planned(dark) and dark.count() == 3 and full.count() == 60


def test_patches_and_their_corners_are_not_broadcast(spark):
    slides = spark.range(2).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slide"))
    M = slides.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("m", (F.col("x") < 2).cast("int"))
    P = slides.withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns(
        {"x": F.col("patch_id") * 10, "y": F.lit(0), "side": F.lit(10)})
    ext = slides.withColumns({"width": F.lit(40), "height": F.lit(40), "tw": F.lit(4), "th": F.lit(4)})
    got = grid.tissue_patches(P, M, ext)
    assert planned(got).count("BroadcastExchange") == 1  # the extent, which is written and measured
    assert sorted((r.slide, r.patch_id, r.tissue_fraction) for r in got.collect()) == [(s, i, 1.0) for s in ("s0", "s1") for i in (0, 1)]


def test_starts_of_rows_are_not_broadcast(spark):
    reg = spark.range(2).select(F.lit("s").alias("slide"), F.col("id").alias("region_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
                                F.lit(64.0).alias("width"), F.lit(48.0).alias("height"))
    g = grid.build_patch_grid(reg, 16)
    assert "Broadcast" not in planned(g)
    assert [r["index"] for r in g.orderBy("region_id", "row", "col").collect()] == [*range(12), *range(12)]


def test_cells_and_labels_read_back_are_not_broadcast(spark, monkeypatch):
    """Files of cells are small, their rows in memory are not."""
    monkeypatch.setattr(cc, "SMALL_LINKS", 0)
    plans = []
    monkeypatch.setattr(cc, "cut_lineage", lambda df, cut=cc.cut_lineage: plans.append(planned(df)) or cut(df))
    ring = np.zeros((12, 12), int)
    ring[2:10, 2:10] = 1
    ring[5:7, 5:7] = 0
    M = cc.cut_lineage(mask_df(spark, ring))
    seeds = cc.label_components(M.withColumn("m", F.when(F.col("y") < 4, F.col("m")).otherwise(0)), 4)
    grown = cc.hysteresis_grow(seeds, M, 4)
    assert grown.count() == 60 and grown.select("label").distinct().count() == 1
    filled = cc.fill_holes(M, 4, 4)
    assert not any("Broadcast" in p for p in [*plans, planned(filled)]) and filled.filter("m = 1").count() == 64
    stats = cc.component_stats(grown).withColumn("max_hole", F.lit(4))
    solid = tissue.solid_fragments(grown, stats, M.select("slide").distinct().withColumns({"w": F.lit(12), "h": F.lit(12)}), 4)
    assert "Broadcast" not in planned(solid) and solid.count() == 64
    window = next(p for p in plans if "__on" in p)  # boxes and slides may be broadcast, cells may not
    assert [line for line in window.splitlines() if "LeftOuter" in line and "SortMergeJoin" not in line] == []


def stacked(spark, n=300):
    rng = np.random.default_rng(9)
    boxes = [(i, *map(float, rng.integers(0, 90, 2)), float(rng.integers(5, 60))) for i in range(n)]
    R = spark.createDataFrame([("s", f"r{i}", "Polygon", poly([(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)])) for i, x, y, a in boxes], REGION)
    pts = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 150, (500, 2)))]
    return boxes, R, pts, spark.createDataFrame(pts, "slide string, point_id long, px double, py double")


@pytest.mark.parametrize("tile", [None, 3.0, 4096.0])
def test_stacked_regions_give_the_smallest_and_the_nearest(spark, tile):
    boxes, R, pts, P = stacked(spark)
    hit = {r.point_id: r.id for r in joins.hit_test(P, R, 1.0, tile).collect()}
    near = {r.point_id: (r.distance, r.id) for r in joins.nearest_region(P, R, 12.0, tile).collect()}
    for _, i, px, py in pts:
        over = [(a * a, f"r{k}") for k, x, y, a in boxes if x <= px < x + a and y <= py < y + a]
        assert hit.get(i) == (min(over)[1] if over else None)

        def away(x, y, a):
            out = np.hypot(max(0, x - px, px - x - a), max(0, y - py, py - y - a))
            return out or min(px - x, x + a - px, py - y, y + a - py)
        d, k = min((round(away(x, y, a), 9), f"r{k}") for k, x, y, a in boxes)
        assert (i in near) == (d <= 12)
        assert d > 12 or (round(near[i][0], 9), near[i][1]) == (d, k)


def test_stacked_outlines_meet_few_points(spark, monkeypatch):
    boxes, R, pts, P = stacked(spark)
    # A region goes to few tiles, whatever lies on it.
    tiles = joins._in_reach(R, 12.0, joins._tile_for(geo.with_bbox(R), 12.0, 4, 4096.0))
    assert tiles.count() <= 12 * len(boxes)
    S = np.array([(x + i * a, y + j * a, x + k * a, y + n * a) for _, x, y, a in boxes for i, j, k, n in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))])
    S = np.vstack([S, S[:40], [[7.0, 7.0, 7.0, 7.0]]])  # the same again, and one of no length
    x, y = np.array([p[2] for p in pts] + [20.0] * 30 + [500.0]), np.array([p[3] for p in pts] + [30.0] * 30 + [500.0])
    D, compared, real = joins._segment_distances(x, y, S), [], joins._segment_distances
    monkeypatch.setattr(joins, "PAIRS", 400)
    monkeypatch.setattr(joins, "_segment_distances", lambda a, b, s: compared.append(len(a) * len(s)) or real(a, b, s))
    point, segment, distance = joins.closest(x, y, S, 12.0)
    assert {(i, j, D[i, j]) for i, j in zip(*np.nonzero((D == D.min(axis=1)[:, None]) & (D <= 12)))} == set(zip(point, segment, distance))
    assert sum(compared) < D.size / 4


def test_hidden_regions_meet_no_points(spark):
    boxes, R, _, _ = stacked(spark)
    sized = R.withColumn("__area", geo.area("polygons"))
    tiles = joins.region_tiles(sized, "id", "__area", tile=3.0)
    assert joins._smallest_over(sized, 3.0).count() < tiles.count() / 3


def test_grid_is_whole_pixels_and_renumbered(spark):
    reg = spark.createDataFrame([("s", 1, 10.4, 20.5, 1024.0, 512.0)], "slide string, region_id int, x double, y double, width double, height double")
    g = grid.build_patch_grid(reg, 256, downsample=1.5).orderBy("index").collect()
    assert [(r["x"], r["y"]) for r in g] == [(10, 21), (394, 21)] and g[0]["side"] == 384
    R = spark.createDataFrame([("s", "a", "Polygon", poly([(300, 0), (800, 0), (800, 900), (300, 900), (300, 0)]))], REGION)
    cut = grid.build_patch_grid(reg, 256, 128, downsample=1.0, within=R).orderBy("index").collect()
    assert [r["index"] for r in cut] == list(range(len(cut))) and all(300 <= r["x"] + 128 < 800 for r in cut)
    assert grid.build_patch_grid(reg, 4096).count() == 0


def test_blend_weights_and_mask(spark):
    P = spark.createDataFrame([("s", i, 50 * i, 0, 100) for i in range(4)], "slide string, patch_id bigint, x bigint, y bigint, side int")
    f = spark.createDataFrame([("s", i, float(i)) for i in range(4)], "slide string, patch_id bigint, value double")
    m = spark.createDataFrame([("s", i, i != 3) for i in range(4)], "slide string, patch_id bigint, in_tissue boolean")
    got = lattice.blend_field(P, f, m, cell=50.0, keep_blank=True).toPandas()
    assert got["value"].between(0, 3).all() and len(got) == 10
    assert not got[got["col"] == 4]["shown"].any() and got[got["col"] == 0]["shown"].all()
    meta = lattice.lattice_meta(P).first()
    assert (meta["step"], meta["cols"], meta["rows"]) == (50, 4, 1)


def test_similar_regions_keep_blobs_apart(spark):
    hot = {(1, 1), (2, 1), (1, 2), (2, 2), (6, 6), (7, 6), (6, 7), (7, 7), (7, 8), (4, 0)}
    cells = [(x, y) for x in range(9) for y in range(9) if (x, y) != (4, 4)]
    P = spark.createDataFrame([("s", i, 100 * x, 100 * y, 224) for i, (x, y) in enumerate(cells)], "slide string, patch_id bigint, x bigint, y bigint, side int")
    f = spark.createDataFrame([("s", i, 1.0 if c in hot else 0.0) for i, c in enumerate(cells)], "slide string, patch_id bigint, value double")
    regions, _ = tissue.similar_regions(f, lattice.lattice_of(P), lattice.lattice_meta(P), 0.5, tolerance=0.0)
    got = geo.with_bbox(regions).orderBy("patches").collect()
    assert [r["patches"] for r in got] == [4, 5]
    assert (got[0]["minx"], got[0]["maxx"]) == (100.0, 300.0)


def test_a_tile_takes_no_more_room_than_its_cells():
    # Cells (10, 5) and (12, 6) of tile (1, 0); of the keys around it only the one beside a cell counts.
    pos = np.array([5 * 256 + 10, 6 * 256 + 12])
    grid, open_, gy, gx = cc._grid(pos, np.array([7, 8]), 256)
    assert grid.shape == open_.shape == (4, 5) and list(grid[gy, gx]) == [7, 8] and open_.sum() == 2
    edge = np.array([5 * 256])
    halo = [{"x": 255, "y": 5, "key": 3}, {"x": 255, "y": 90, "key": 1}]
    grid, open_, gy, gx = cc._grid(edge, np.array([9]), 256, halo, 1, 0)
    assert grid.shape == (3, 3) and list(cc._settle(grid, open_, 0)[gy, gx]) == [3]


def test_small_tiles_are_unpacked_together():
    pack = lambda a, t: np.array(a, t).tobytes()
    rows = pd.DataFrame([("s", tx, 0, pack([1, 256], np.uint32), pack([tx, 9], np.int64)) for tx in range(3)], columns=["slide", "tx", "ty", "pos", "key"])
    got = list(cc._unpacked(lambda r, pos, key: (pos, key), 256)([rows]))
    assert len(got) == 1
    assert got[0][["tx", "x", "y", "key"]].to_numpy().tolist() == [[t, t * 256 + x, y, k] for t in range(3) for x, y, k in ((1, 0, t), (0, 1, 9))]
