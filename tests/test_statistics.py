import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchframe.functions import scalar
from patchframe.operators import enrichment, expression, gradient, halves, quantise, signatures, stats


def make_map(spark, values, side=100, xy=None, slide="s", inside=None):
    """(E, G) of a patches x genes array on one row of patches."""
    rows = [
        (slide, i, *(xy[i] if xy else (i * side, 0)), side, [float(v) for v in r],
         bool(i in inside) if inside is not None else False)
        for i, r in enumerate(values)
    ]
    E = spark.createDataFrame(rows, "slide string, patch_id bigint, x bigint, y bigint, side int, values array<float>, inside boolean")
    G = spark.createDataFrame(
        [(slide, g, f"G{g}", None, None) for g in range(len(values[0]))],
        "slide string, gene_idx int, gene string, scale float, zero float")
    return E, G


def brute_auc(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(120, 5)), 1)
    v[:, 2] = rng.integers(-2, 3, 120)
    v[5, 0], v[6, 0] = -0.0, 0.0
    v[:, 4] = 7.0
    return v.astype(np.float32)


def test_auc_equals_counting_pairs(spark, noisy):
    inside = set(range(0, 120, 3))
    E, G = make_map(spark, noisy, inside=inside)
    got = {r["gene"]: r for r in enrichment.differential_expression(E, G).collect()}
    mask = np.array([i in inside for i in range(120)])
    for g in range(5):
        assert got[f"G{g}"]["auc"] == pytest.approx(brute_auc(noisy[mask, g], noisy[~mask, g]), abs=1e-12)
    assert got["G4"]["auc"] == 0.5 and got["G4"]["p"] == pytest.approx(1.0, abs=1e-6)
    rank = expression.long_values(E, "inside")
    u = {r["gene_idx"]: r["u"] for r in stats.mann_whitney_rank(rank, ["slide", "gene_idx"], "value", F.col("inside")).collect()}
    assert u[0] == pytest.approx(got["G0"]["auc"] * 40 * 80, abs=1e-9)


def test_swapping_the_groups_mirrors_the_auc(spark, noisy):
    E, G = make_map(spark, noisy, inside=set(range(30)))
    a = {r["gene"]: r["auc"] for r in enrichment.differential_expression(E, G).collect()}
    swapped = E.withColumn("inside", ~F.col("inside")).repartition(7)
    b = {r["gene"]: r["auc"] for r in enrichment.differential_expression(swapped, G).collect()}
    for g in a:
        assert a[g] + b[g] == pytest.approx(1.0)


def test_half_patterns_order_and_tie_as_their_values():
    bits = np.arange(1 << 16, dtype=np.uint16)
    v = bits.view(np.float16).astype(np.float64)
    key = halves.in_order(bits)
    back = halves.key_values()[key]
    assert np.array_equal(back, v, equal_nan=True)
    order = np.argsort(key, kind="stable")
    number = ~np.isnan(v[order])
    assert (np.diff(v[order][number]) >= 0).all() and not number[-2046:].any()
    assert key[0x8000] == key[0]  # both zeros


def test_halves_give_the_test_of_the_widened_values(spark):
    rng = np.random.default_rng(11)
    v = np.where(rng.random((300, 37)) < 0.4, 0, rng.normal(size=(300, 37)) * 10.0 ** rng.integers(-7, 4, 37))
    v[3, 0], v[4, 0], v[:, 5], v[9, 6], v[10, 6] = -0.0, 0.0, 7.0, 1e9, -1e9  # tied zeros, a flat gene, infinities
    a, Ga = make_map(spark, v[:200], inside=set(range(0, 200, 3)), slide="a")
    c, Gc = make_map(spark, v[200:, :20], inside=set(range(40)), slide="c")
    H = halves.pack_halves(a.unionByName(c)).repartition(7)
    G = Ga.unionByName(Gc)
    wide = halves.unpack_halves(H)
    assert expression.as_arrays(H).exceptAll(wide).count() == 0
    half = np.float32(v[:200]).clip(-1e6, 1e6)
    half = np.where(half > 65504, np.inf, np.where(half < -65504, -np.inf, half)).astype(np.float16).astype(np.float32)
    rows = {r["patch_id"]: r["values"] for r in wide.where("slide = 'a'").collect()}
    assert all(np.array_equal(rows[i], half[i]) for i in rows) and len(rows) == 200
    keys = ["u", "n_in", "n_out", "sum_in", "sum_out"]
    got = {(r["slide"], r["gene_idx"]): r for r in halves.mann_whitney_halves(H).collect()}
    long = expression.long_values(wide, "inside")
    want = stats.mann_whitney(stats.group_histogram(long, ["slide", "gene_idx"], "value", F.col("inside")), ["slide", "gene_idx"]).collect()
    assert len(got) == len(want) == 57
    for r in want:
        for k in keys:
            if not math.isnan(r[k]):  # a sum over histograms of infinities
                assert got[r["slide"], r["gene_idx"]][k] == pytest.approx(r[k], rel=1e-9), (r, k)
    assert all(not math.isnan(r["sum_out"]) for r in got.values())
    rows = enrichment.differential_expression(H, G).collect()
    assert {(r["slide"], r["gene_idx"]): r["auc"] for r in rows} == {
        (r["slide"], r["gene_idx"]): r["auc"] for r in enrichment.differential_expression(wide, G).collect()}
    assert expression.gene_values(H, G, "G3").exceptAll(expression.gene_values(wide, G, "G3")).count() == 0


def test_counts_of_halves_meet_in_two_steps_and_stay_small(spark):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((1500, 40)) < 0.5, 0, rng.gamma(2, 1, (1500, 40)))
    E, _ = make_map(spark, v, inside=set(range(0, 1500, 4)))
    H = halves.pack_halves(E.repartition(6)).cache()
    want = halves.mann_whitney_halves(H).orderBy("gene_idx").collect()
    kinds = "slide string, block int, part bigint, counts binary"
    handed = H.select("slide", "inside", "halves").mapInArrow(halves._counter(halves.HELD, halves.SPREAD), kinds).agg(F.sum(F.length("counts"))).first()[0]
    assert handed <= 1500 * 40 * 2
    # Every partition its own first step, a few values held at a time: same result.
    apart = halves.mann_whitney_halves(H, held=500, spread=1).orderBy("gene_idx").collect()
    assert [r["u"] for r in apart] == [r["u"] for r in want] and len(want) == 40


def test_halves_that_are_missing_or_empty(spark):
    kind = "slide string, patch_id bigint, inside boolean, values array<float>"
    E = spark.createDataFrame([("s", 0, True, [1.0, None]), ("s", 1, None, [2.0, 3.0]), ("s", 2, False, None), ("t", 3, True, [])], kind)
    H = halves.pack_halves(E)
    got = {r["gene_idx"]: (r["u"], r["n_in"], r["n_out"]) for r in halves.mann_whitney_halves(H).collect()}
    assert got == {0: (0.0, 1, 1), 1: (1.0, 1, 1)}  # NaN is above all else
    assert halves.unpack_halves(H).where("patch_id = 2").first()["values"] is None
    assert halves.mann_whitney_halves(H.limit(0)).count() == 0


def _shuffles(df):
    """Keys of the exchanges of a plan, joins by sorting included."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "patch_id" in line] + [
        line for line in plan.splitlines() if "SortMergeJoin" in line]


def test_wide_rows_stay_where_they_lie(spark):
    """Flags and corridors of a map beyond the optimiser's broadcast limit, and the same rows by keys."""
    from patchframe.operators import joins

    rng = np.random.default_rng(2)
    E, G = make_map(spark, rng.normal(size=(60, 6)), inside=set())
    ring = [(450.0, -50.0), (2250.0, -50.0), (2250.0, 90.0), (450.0, 90.0), (450.0, -50.0)]
    R = spark.createDataFrame(
        [("s", "r", "Polygon", [[ring]], "c"), ("s", "q", "Polygon", [[[(x + 3000, y) for x, y in ring]]], "c"), ("t", "o", "Polygon", [[ring]], "c")],
        "slide string, id string, geom_type string, polygons array<array<array<struct<x:double,y:double>>>>, class_id string")
    axes = spark.createDataFrame([("s", 1, 0.0, 50.0, 5000.0, 50.0, 80.0), ("s", 2, 4000.0, 50.0, 100.0, 50.0, 80.0)],
                                 "slide string, axis_id int, ax double, ay double, bx double, by double, width double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = joins.flag_inside(E, R)
        along = joins.patches_along(E, axes)
        assert flagged.columns == E.columns and not _shuffles(flagged) and not _shuffles(along)
        got = {r["patch_id"] for r in flagged.where("inside").collect()}
        assert got == {i for i in range(60) if 450 <= i * 100 + 50 < 2250 or 3450 <= i * 100 + 50 < 5250}  # right edges are open
        pos = along.select("slide", "patch_id", "axis_id")
        fetched = expression.with_rows(E, pos, ["slide", "patch_id"])
        assert not _shuffles(fetched)
        assert _shuffles(expression.with_rows(E, pos, ["slide", "patch_id"], small_bytes=0))
        assert fetched.count() == along.count() == expression.with_rows(E, pos, ["slide", "patch_id"], small_bytes=0).count() > 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    large = joins.flag_inside(E, R, small_bytes=0)
    assert large.select("patch_id", "inside").exceptAll(flagged.select("patch_id", "inside")).count() == 0
    H = halves.pack_halves(E)
    a = {(r["axis_id"], r["gene"]): r["rho"] for r in gradient.gene_gradient(H, G, axes).collect()}
    b = {(r["axis_id"], r["gene"]): r["rho"] for r in gradient.gene_gradient(halves.unpack_halves(H), G, axes).collect()}
    assert a == b and len(a) == 12


def test_codes_give_the_same_test_as_decoded_values(spark, noisy):
    E, G = make_map(spark, noisy, inside=set(range(50)))
    E8, G8, report = quantise.quantise(E, G, quantise.choose_genes(expression.survey_genes(E), min_expression=-1e9))
    flags = E.select("slide", "patch_id", "inside")
    coded = {r["gene"]: r for r in enrichment.differential_expression(E8.join(flags, ["slide", "patch_id"]), G8).collect()}
    plain = {r["gene"]: r for r in enrichment.differential_expression(
        expression.decode(E8, G8).join(flags, ["slide", "patch_id"]), G8).collect()}
    packed = expression.pack_codes(E8)
    assert packed.schema["values"].dataType.typeName() == "binary"
    same = {r["gene"]: r for r in enrichment.differential_expression(packed.join(flags, ["slide", "patch_id"]), G8).collect()}
    assert same == coded
    assert expression.unpack_codes(packed).exceptAll(E8).count() == 0
    for g, r in coded.items():
        assert r["auc"] == plain[g]["auc"]
        assert r["mean_in"] == pytest.approx(plain[g]["mean_in"], abs=1e-5)
    worst = report.first()["worst_error"]
    assert worst <= float((noisy.max(0) - np.minimum(0, noisy.min(0))).max()) / 255 / 2 + 1e-5
    with pytest.raises(ValueError):
        quantise.quantise(E8, G8, quantise.choose_genes(expression.survey_genes(E8), min_expression=-1e9))


def test_region_too_small(spark, noisy):
    E, G = make_map(spark, noisy, inside={1, 2})
    with pytest.raises(Exception, match="at least 5 patches"):
        enrichment.differential_expression(E, G).collect()
    assert enrichment.differential_expression(E, G, on_small="drop").count() == 0


def test_modules_no_map_can_score_raise(spark, noisy):
    E, G = make_map(spark, noisy, inside=range(20))
    S = spark.createDataFrame([(0, "known", "G0", 1.0), (1, "strange", "NOT-HERE", 1.0)], "sig_idx int, name string, gene string, weight double")
    arrows = axis(spark, 50, 50, 2950, 50)
    assert {r["name"] for r in enrichment.differential_signatures(E, G, S).collect()} == {"known"}
    strange = S.filter("sig_idx = 1")
    for found in (enrichment.differential_signatures(E, G, strange), gradient.signature_gradient(E, G, arrows, strange)):
        with pytest.raises(Exception, match="none can be scored"):
            found.collect()
    assert enrichment.differential_signatures(E, G, strange, on_small="drop").count() == 0
    assert gradient.signature_gradient(E, G, arrows, strange, on_small="drop").count() == 0


def test_floor_comes_before_correction(spark):
    rng = np.random.default_rng(1)
    v = np.hstack([rng.normal(5, 1, (60, 2)), rng.normal(0, 0.001, (60, 20))])
    v[:20, 0] += 3
    E, G = make_map(spark, v, inside=set(range(20)))
    few = {r["gene"]: r["q"] for r in enrichment.differential_expression(E, G, min_expression=1.0).collect()}
    all_ = {r["gene"]: r["q"] for r in enrichment.differential_expression(E, G).collect()}
    assert set(few) == {"G0", "G1"} and few["G0"] < all_["G0"]


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.96, 3.3, -1.0, 6.0]
    d = spark.createDataFrame([(z,) for z in zs], "z double").select("z", scalar.normal_sf("z").alias("p"))
    for r in d.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=3e-7, abs=1e-12)


def test_value_bucket_never_decreases(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=500), rng.normal(size=200) * 1e-30, rng.normal(size=200) * 1e30,
                        [0.0, 1.0, 2.0, -1.0, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")]])
    d = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", scalar.value_bucket("v").alias("b")).toPandas()
    d = d.sort_values("v")
    assert (d["b"].diff().dropna() >= 0).all()


def test_nearest_rank_does_not_interpolate(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(size=777), 2)
    d = spark.createDataFrame([("s", float(x)) for x in v] + [("flat", 4.0)] * 9, "slide string, value double")
    got = {r["slide"]: r for r in stats.nearest_rank(d, "slide", "value", {"p2": 2, "p50": 50, "p98": 98}).collect()}
    s = np.sort(v)
    for k, p in (("p2", 2), ("p50", 50), ("p98", 98)):
        assert got["s"][k] == s[math.floor(p / 100 * (len(s) - 1) + 0.5)]
    rr = {r["slide"]: r for r in stats.robust_range(d).collect()}
    assert (rr["flat"]["lo"], rr["flat"]["hi"]) == (3.5, 4.5)


def test_row_numbers_without_a_group_sort(spark):
    d = spark.range(1000).select(F.lit("s").alias("slide"), (F.col("id") * 37 % 1000).alias("k"))
    out = stats.row_numbers(d, "slide", F.floor(F.col("k") / 64), [F.col("k")], "i").filter("i <> k")
    assert out.count() == 0


def axis(spark, *p, width=200.0):
    return spark.createDataFrame([("s", 1, *map(float, p), width)],
                                 "slide string, axis_id int, ax double, ay double, bx double, by double, width double")


def test_gradient_directions_and_reversal(spark):
    rng = np.random.default_rng(2)
    t = np.arange(30)
    v = np.stack([t + rng.normal(0, .1, 30), -t + rng.normal(0, .1, 30), np.full(30, 2.0), t.astype(float)], axis=1)
    E, G = make_map(spark, v)
    got = {r["gene"]: r for r in gradient.gene_gradient(E, G, axis(spark, 50, 50, 2950, 50)).collect()}
    assert got["G0"]["rho"] > 0.95 and got["G1"]["rho"] < -0.95 and got["G2"]["rho"] == 0
    assert got["G3"]["rho"] == 1.0 and got["G3"]["p"] == 0.0
    assert got["G3"]["mean_start"] == pytest.approx(4.5) and got["G3"]["mean_end"] == pytest.approx(24.5)
    back = {r["gene"]: r for r in gradient.gene_gradient(E, G, axis(spark, 2950, 50, 50, 50)).collect()}
    for g in got:
        assert back[g]["rho"] == pytest.approx(-got[g]["rho"], abs=1e-12)
    with pytest.raises(Exception, match="at least 8"):
        gradient.gene_gradient(E, G, axis(spark, 50, 50, 450, 50)).collect()


def test_spearman_matches_ranked_correlation(spark):
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(60, 3)), 1)
    xy = [(int(a) * 100, int(b) * 100) for a, b in rng.integers(0, 12, (60, 2))]
    E, G = make_map(spark, v, xy=xy)
    got = {r["gene_idx"]: r["rho"] for r in gradient.gene_gradient(E, G, axis(spark, 0, 0, 1200, 900, width=5000.0)).collect()}
    ax = np.array([1200.0, 900.0])
    t = (np.array(xy) + 50) @ ax / (ax @ ax)
    keep = (t >= 0) & (t <= 1)

    def ranks(a):
        s = np.sort(a)
        return (np.searchsorted(s, a, "left") + np.searchsorted(s, a, "right") + 1) / 2

    for g in range(3):
        want = np.corrcoef(ranks(v[keep, g].astype(np.float32)), ranks(np.round(t[keep], 12)))[0, 1]
        assert got[g] == pytest.approx(want, abs=1e-9)


def test_scores_ignore_scale_and_skip_what_is_missing(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 4))
    v[:, 0] *= 1000
    v[:, 3] = 1.0
    E, G = make_map(spark, v)
    S = spark.createDataFrame(
        [(0, "m", "G0", 1.0, None), (0, "m", "G1", -2.0, None), (0, "m", "G3", 5.0, None), (1, "none", "ZZ", 1.0, None),
         (2, "flat", "G3", 1.0, None)], "sig_idx int, name string, gene string, weight double, cells bigint")
    got = signatures.score_signatures(E, G, S).toPandas()
    assert set(got["name"]) == {"m"}
    v32 = v.astype(np.float32).astype(float)
    z = (v32 - v32.mean(0)) / np.where(v32.std(0) > 0, v32.std(0), 1)
    want = (z[:, 0] - 2 * z[:, 1]) / 3
    assert np.allclose(got.sort_values("patch_id")["score"], want, atol=1e-6)
    assert {r["name"]: r["found"] for r in signatures.usable_signatures(G, S, 1).collect()} == {"m": 3, "flat": 1}


def test_module_is_signed_and_capped(spark):
    d = spark.createDataFrame(
        [("s", i, f"G{i}", a) for i, a in enumerate([0.9, 0.1, 0.55, 0.75, 0.5])], "slide string, gene_idx int, gene string, auc double")
    got = [(r["gene"], r["weight"]) for r in enrichment.module_from_enrichment("m", d, top=2).orderBy("rank").collect()]
    assert got == [("G0", 0.8), ("G1", -0.8)]


def test_shards(spark):
    rows = spark.createDataFrame(
        [("r", s, i, float(s * 3 + i)) for s in (1, 2, 3) for i in range(3)], "run string, shard int, row bigint, v double")
    head = spark.createDataFrame([("r", s, 3, 3, 224) for s in (3, 1, 2)], "run string, shard int, of int, n_rows bigint, side int")
    merged, problems = quantise.merge_shards(rows, head)
    assert problems.count() == 0
    assert [r["v"] for r in merged.orderBy("patch_id").collect()] == [float(v) for v in range(3, 12)]
    for bad, word in ((head.filter("shard <> 2"), "missing"), (head.union(head.filter("shard = 1")), "appears"),
                      (head.withColumn("side", F.col("shard")), "side"), (head.withColumn("n_rows", F.lit(4).cast("bigint")), "holds 3")):
        m, p = quantise.merge_shards(rows, bad)
        assert m.count() == 0 and any(word in r["problem"] for r in p.collect())


def test_small_sides_do_not_move_the_map(spark):
    from patchframe.operators import expression, signatures

    rows = [(s, i, i % 5, i // 5, 1, [int((i * g + g) % 200) for g in range(6)]) for s in ("a", "b") for i in range(40)]
    E = spark.createDataFrame(rows, "slide string, patch_id bigint, x bigint, y bigint, side int, values array<smallint>")
    G = spark.createDataFrame([(s, g, f"G{g}", 0.5, 1.0) for s in ("a", "b") for g in range(6)], "slide string, gene_idx int, gene string, scale float, zero float")
    S = spark.createDataFrame([(0, "m", "G1", 1.0, None), (0, "m", "G3", 2.0, None), (1, "n", "none", 1.0, None)], "sig_idx int, name string, gene string, weight double, cells bigint")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = signatures.score_signatures(E, G, S)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
        weights = signatures.signature_weights(E, G, S)
        same = lambda df: sorted(map(tuple, df.select("slide", "patch_id", "name", "total").collect()))
        assert same(expression.beside(E, weights)) == same(expression.beside(E, weights, small_bytes=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    # All layouts of a map give the same scores and genes.
    packed = expression.pack_codes(E)
    key = lambda df: sorted((r["slide"], r["patch_id"], round(r[-1], 9)) for r in df.collect())
    assert key(signatures.score_signatures(packed, G, S)) == key(scores)
    values = expression.decode(packed, G)
    assert key(expression.gene_values(packed, G, "G2")) == key(expression.gene_values(values, G, "G2")) == key(expression.gene_values(E, G, "G2"))
    assert {(r["name"], r["found"]) for r in signatures.signature_coverage(G, S).collect()} == {("m", 2), ("n", 0)}
