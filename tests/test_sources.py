import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchframe.functions import geometry as geo
from patchframe.operators import annotations as an
from patchframe.sources import documents, exports, listing
from patchframe.sources import expression_map as em
from patchframe.sources.stores import EmbeddingStore, ModelStore
from patchframe.streaming import jobs


def write_map(path, values, dtype="float16", **extra):
    n, g = values.shape
    head = {"slide": "a.svs", "genes": [f"G{i}" for i in range(g)], "patches": [{"x": 10 * i, "y": 5} for i in range(n)],
            "side": 10, "dtype": dtype, "model": f"m ({g} genes)", **extra}
    blob = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(em.MAGIC + struct.pack("<I", len(blob)) + blob + values.astype(em.DTYPES[dtype]).tobytes())
    return str(path)


@pytest.mark.parametrize("dtype", ["float16", "float32"])
def test_map_is_read_in_ranges(spark, tmp_path, dtype):
    v = np.random.default_rng(0).normal(size=(57, 4))
    v[3] = [np.inf, -np.inf, 6e-8, -0.0]
    p = write_map(tmp_path / "a.expression.bin", v, dtype)
    E, G = em.read_expression_maps(spark, [p], rows_per_partition=10)
    got = E.orderBy("patch_id").toPandas()
    want = v.astype(em.DTYPES[dtype]).astype(np.float32)
    assert np.array_equal(np.stack(got["values"]), want)
    if dtype == "float16":
        raw = em.read_expression_maps(spark, [p], rows_per_partition=10, codes="halves")[0].orderBy("patch_id").toPandas()
        assert list(raw["halves"]) == [r.tobytes() for r in v.astype("<f2")]
    else:
        with pytest.raises(Exception, match="not a float16 map"):
            em.read_expression_maps(spark, [p], codes="halves")[0].count()
    assert list(got["x"]) == [10 * i for i in range(57)] and [r["gene"] for r in G.orderBy("gene_idx").collect()] == ["G0", "G1", "G2", "G3"]


def test_byte_maps_and_bad_files(spark, tmp_path):
    codes = np.random.default_rng(1).integers(0, 256, (20, 3))
    s, z = [0.5, 0.01, 1.0], [0.0, -1.0, 0.0]
    good = write_map(tmp_path / "q.bin", codes, "uint8", scale=s, zero=z)
    E, _ = em.read_expression_maps(spark, [good])
    assert np.allclose(np.stack(E.orderBy("patch_id").toPandas()["values"]), codes * s + np.array(z), atol=1e-4)
    E8, G8 = em.read_expression_maps(spark, [good], codes=True)
    assert np.array_equal(np.stack(E8.orderBy("patch_id").toPandas()["values"]), codes)
    P8, _ = em.read_expression_maps(spark, [good], rows_per_partition=7, codes="packed")
    assert [list(r["values"]) for r in P8.orderBy("patch_id").collect()] == codes.tolist()
    assert [r["scale"] for r in G8.orderBy("gene_idx").collect()] == pytest.approx(s)
    bad = [write_map(tmp_path / "noscale.bin", codes, "uint8")]
    (tmp_path / "magic.bin").write_bytes(b"NOTAMAP!" + b"\0" * 40)
    (tmp_path / "short.bin").write_bytes(b"abc")
    raw = open(good, "rb").read()
    (tmp_path / "cut.bin").write_bytes(raw[:-5])
    (tmp_path / "head.bin").write_bytes(raw[:30])
    bad += [str(tmp_path / f"{n}.bin") for n in ("magic", "short", "cut", "head")]
    h = {r["path"]: r["error"] for r in em.read_headers(spark, [good, *bad]).collect()}
    assert h[good] is None and all(h[b] for b in bad)
    ok, _ = em.read_expression_maps(spark, [good, *bad], on_bad="skip")
    assert ok.count() == 20
    with pytest.raises(Exception):
        em.read_expression_maps(spark, bad)[0].count()


CLASSES = "ordinal int, class_id string, name string, color int"


def test_geojson_shapes_classes_and_measurements(spark, tmp_path):
    sq = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    feats = [
        {"type": "Feature", "id": "one", "geometry": {"type": "Polygon", "coordinates": sq},
         "properties": {"objectType": "annotation", "classification": {"name": "Tumour Core", "colorRGB": -65536}, "isLocked": True,
                        "measurements": [{"name": "area", "value": 16.0}], "patchframe": {"id": "uid1", "source": "model", "modelId": "tissue-1"}}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [sq, [[[9, 9], [10, 9], [10, 10], [9, 9]]]]},
         "properties": {"classification": {"name": "stroma"}, "measurements": {"n": 2.5}}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"classification": {"name": "Region*"}}},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": []}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [5, 5]]}, "properties": {}},
    ]
    d = tmp_path / "in"
    d.mkdir()
    (d / "fc.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (d / "list.geojson").write_text(json.dumps(feats[:2], indent=1))
    (d / "single.geojson").write_text(json.dumps(feats[0]))
    classes = spark.createDataFrame([(0, "st", "Stroma", 1)], CLASSES)
    R, every, skipped = documents.read_geojson(spark, str(d), classes.drop("color"))
    rows = {(r["slide"], r["geom_type"]): r for r in R.collect()}
    a = rows["fc", "Polygon"]
    assert (a["id"], a["class_id"], a["source"], a["locked"], a["measurements"]) == ("uid1", "tumour-core", "model", True, {"area": 16.0})
    assert rows["fc", "MultiPolygon"]["class_id"] == "st" and rows["fc", "MultiPolygon"]["measurements"] == {"n": 2.5}
    assert rows["fc", "Point"]["class_id"] == "__roi__" and rows["fc", "LineString"]["class_id"] is None
    assert len([k for k in rows if k[0] == "list"]) == 2 and ("single", "Polygon") in rows
    assert {r["file"].split("/")[-1]: r["skipped"] for r in skipped.collect()}["fc.geojson"] == 1
    assert [(r["class_id"], r["ordinal"]) for r in every.orderBy("ordinal").collect()] == [("st", 0), ("tumour-core", 1)]
    out = str(tmp_path / "out")
    documents.write_geojson(R, every, out, max_features=2)
    back, _, _ = documents.read_geojson(spark, out, every)
    key = lambda df: sorted((r["id"], r["geom_type"], r["class_id"], r["minx"], r["maxy"], r["locked"]) for r in df.collect())
    assert key(back) == key(R)
    documents.write_geojson(R, every, out)  # one Feature a line
    assert key(documents.read_geojson(spark, out, every)[0]) == key(R)


def test_signature_files(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"source": "x", "signatures": [
        {"name": " A ", "cells": 9, "genes": ["G1", {"gene": "G2", "weight": 0.5}, {"gene": "G3", "weight": None}, {"weight": 2}]},
        {"name": "", "genes": ["G1"]}, {"name": "B", "genes": []}]}))
    got = {(r["name"], r["gene"]): r["weight"] for r in documents.read_signatures(spark, str(f)).collect()}
    assert got == {("A", "G1"): 1.0, ("A", "G2"): 0.5, ("A", "G3"): 1.0}
    (tmp_path / "e.json").write_text('{"signatures": []}')
    with pytest.raises(ValueError):
        documents.read_signatures(spark, str(tmp_path / "e.json"))


def test_listing_and_sidecars(spark):
    paths = ["a/x.svs", "a/x.geojson", "a/x.json", "a/y.svs", "a/y.onnx.json", "a/y.json", "b/m.mrxs", "b/m/Slidedat.ini", "b/m/Data0.dat",
             "b/n.mrxs", "c/v.vms", "c/v_1.jpg", "d/1.dcm", "d/2.dcm", "x.svs", "x.expr", "X.expression.bin"]
    f = spark.createDataFrame([(p, 2) for p in paths], "path string, length bigint")
    slides, members = listing.resolve_slides(f)
    s = {r["entry_path"]: r for r in slides.collect()}
    assert set(s) == {"a/x.svs", "a/y.svs", "b/m.mrxs", "b/n.mrxs", "c/v.vms", "d/1.dcm", "x.svs"}
    assert s["b/m.mrxs"]["n_files"] == 3 and s["b/m.mrxs"]["warning"] is None and "missing" in s["b/n.mrxs"]["warning"]
    assert s["d/1.dcm"]["name"] == "d" and s["d/1.dcm"]["bytes"] == 4 and s["c/v.vms"]["n_files"] == 2
    p = {r["entry_path"]: (r["annotations"], r["expression"]) for r in listing.pair_sidecars(slides, f).collect()}
    assert p["a/x.svs"] == ("a/x.geojson", None) and p["a/y.svs"] == ("a/y.json", None) and p["x.svs"] == (None, "x.expr")
    d = spark.createDataFrame([("q/Slide1.expression.bin", "w/slide1.svs"), ("q/other.expr", "w/slide1.svs")], "m string, s string")
    assert [r[0] for r in d.select(listing.map_names_slide(F.col("m"), F.col("s"))).collect()] == [True, False]


SHARD_ROWS = "slide string, model_id string, level int, patch_px int, patch_key string, vec array<float>"


def test_embedding_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "emb"), 3)
    assert store.read().count() == 0
    rows = lambda v: spark.createDataFrame([("s", "m", 0, 224, k, [float(v)] * 3) for k in ("a", "b")], SHARD_ROWS)
    store.append(rows(1), batch=1)
    store.append(rows(2).filter("patch_key = 'a'"), batch=2)
    got = {r["patch_key"]: r["vec"][0] for r in store.read().collect()}
    assert got == {"a": 2.0, "b": 1.0} and store.bytes().first()["bytes"] == 24
    with pytest.raises(Exception, match="the store holds 3"):
        store.append(rows(1).withColumn("vec", F.slice("vec", 1, 2)), batch=3)
    assert EmbeddingStore(spark, str(tmp_path / "emb"), 4).read().count() == 0
    store.clear(rows(1), batch=4)
    assert store.read().count() == 0
    store.append(rows(5), batch=5)
    assert store.read().count() == 2


def make_encoder():
    def encoder(batches):
        for b in batches:
            yield b[["patch_key"]].assign(vec=[[float(len(k)), 1.0, 2.0] for k in b["patch_key"]])

    return encoder


def test_streamed_embeddings_encode_only_what_is_new(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "emb"), 3)
    src = str(tmp_path / "in")
    P = lambda ks: spark.createDataFrame([("s", "m", 0, 224, k) for k in ks], "slide string, model_id string, level int, patch_px int, patch_key string")
    P("a").write.mode("append").parquet(src)
    run = lambda: jobs.stream_embeddings(spark.readStream.schema(P("a").schema).parquet(src), make_encoder(), store, str(tmp_path / "cp")).awaitTermination()
    run()
    P(["a", "bb", "bb"]).write.mode("append").parquet(src)
    run()
    assert {r["patch_key"]: r["vec"][0] for r in store.read().collect()} == {"a": 1.0, "bb": 2.0}
    assert spark.read.parquet(store.path).count() == 2
    zero = lambda bs: (b[["patch_key"]].assign(vec=[[0.0] * 3] * len(b)) for b in bs)
    from patchframe.operators.learn import embed_patches
    with pytest.raises(Exception, match="unusable vector"):
        embed_patches(P(["z"]), zero, store.read(), 3).collect()


def test_streamed_shards_wait_for_the_whole_run(spark, tmp_path):
    schema = "run string, shard int, of int, row bigint, n_rows bigint, v double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = lambda run, s: spark.createDataFrame([(run, s, 2, i, 2, float(10 * s + i)) for i in range(2)], schema)
    run = lambda: jobs.stream_shards(
        spark.readStream.schema(schema).parquet(src), jobs.shard_headers, str(tmp_path / "st"), out, str(tmp_path / "cp")).awaitTermination()
    part("r", 2).write.mode("append").parquet(src)
    run()
    assert jobs.read_runs(spark, out).count() == 0
    part("r", 1).write.mode("append").parquet(src)
    part("r", 2).write.mode("append").parquet(src)
    run()
    part("r", 1).write.mode("append").parquet(src)
    run()
    assert [(r["patch_id"], r["v"]) for r in spark.read.parquet(out).orderBy("patch_id").collect()] == [(0, 10.0), (1, 11.0), (2, 20.0), (3, 21.0)]


def test_a_repeated_batch_after_a_half_written_one_gives_each_run_once(spark, tmp_path):
    schema = "run string, shard int, of int, row bigint, n_rows bigint, v double"
    st, out = str(tmp_path / "st"), str(tmp_path / "out")
    shard = lambda run, s: [(run, s, 2, i, 2, float(10 * s + i)) for i in range(2)]
    batch = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda: sorted((r["run"], r["patch_id"], r["v"]) for r in jobs.read_runs(spark, out).collect())
    whole = lambda run: [(run, 0, 10.0), (run, 1, 11.0), (run, 2, 20.0), (run, 3, 21.0)]
    jobs.merge_batch(batch(shard("007", 1) + shard("007", 2)), 0, jobs.shard_headers, st, out)
    assert rows() == whole("007")  # a run's name stays text
    # Batch 1 staged its rows twice and wrote half of its runs, none of them closed.
    again = batch(shard("007", 2) + shard("b", 1) + shard("b", 2) + shard("c", 1))
    again.withColumn("batch", F.lit(1)).write.mode("append").partitionBy("run").parquet(st)
    spark.createDataFrame([(10.0, 0, 1, "b"), (99.0, 9, 1, "b")], "v double, patch_id bigint, batch int, run string").write.mode(
        "append").partitionBy("run").parquet(out)
    assert rows() == whole("007")
    jobs.merge_batch(again, 1, jobs.shard_headers, st, out)
    assert rows() == whole("007") + whole("b")
    # Written and closed, but not yet marked as done by the stream: repeated once more.
    jobs.merge_batch(again, 1, jobs.shard_headers, st, out)
    jobs.merge_batch(batch(shard("c", 2)), 2, jobs.shard_headers, st, out)
    assert rows() == whole("007") + whole("b") + whole("c")
    closed = spark.read.parquet(f"{out}-closed").orderBy("run").collect()
    assert [(r["run"], r["rows"], r["batch"]) for r in closed] == [("007", 4, 0), ("b", 4, 1), ("c", 4, 2)]


def test_keys_of_a_store_are_read_without_vectors(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "emb"), 2)
    rows = lambda slide, ks: spark.createDataFrame([(slide, "m", 0, 224, k, [1.0, 2.0]) for k in ks], SHARD_ROWS)
    assert store.keys(rows("s", "a")).count() == 0
    store.append(rows("s", "ab"), batch=1)
    store.append(rows("t", "c"), batch=1)
    EmbeddingStore(spark, store.path, 3).append(rows("s", "z").withColumn("vec", F.array(*[F.lit(1.0).cast("float")] * 3)), batch=2)
    assert sorted(r["patch_key"] for r in store.keys().collect()) == ["a", "b", "c"]
    some = store.keys(rows("s", "q"))
    assert sorted(r["patch_key"] for r in some.collect()) == ["a", "b"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "vec" not in plan and "dynamicpruning" in plan.lower()
    store.clear(rows("s", "a"), batch=3)
    assert [r["patch_key"] for r in store.keys().collect()] == ["c"]


def test_streamed_edits_match_the_batch_replay(spark, tmp_path):
    schema = "slide string, id string, seq bigint, op string, after string"
    src = str(tmp_path / "in")
    for part in ([("s", "a", 1, "added", "1"), ("s", "b", 5, "removed", None)], [("s", "b", 2, "added", "2"), ("s", "a", 7, "updated", "3")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    q = jobs.replay_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format(
        "memory").queryName("edits").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("edits").groupBy("slide", "id").agg(F.max_by(F.struct("op", "after"), "seq").alias("l")).filter("l.op <> 'removed'")
    log = spark.read.schema(schema).parquet(src).withColumn("before", F.lit(None).cast("string"))
    assert [(r["id"], r["l"]["after"]) for r in last.collect()] == [(r["id"], r["state"]) for r in an.replay_changes(log).collect()] == [("a", "3")]
    # Undoing everything after entry 1 needs what each entry replaced.
    before = F.when(F.col("seq") == 7, "1").when(F.col("seq") == 5, "2")
    log = log.withColumn("before", before)
    undo = an.inverse_changes(log, 1, 8)
    assert [(r["id"], r["state"]) for r in an.replay_changes(log.unionByName(undo.select(*log.columns))).collect()] == [("a", "1")]


def test_model_store(spark, tmp_path):
    from patchframe.operators.learn import LinearModel

    m = lambda version: LinearModel("tissue", ["a", "t"], [[0.1] * 12], [0.0], [0.0] * 12, [1.0] * 12, {"tissue": 3, "artefact": 2}, feature_version=version)
    st = ModelStore(spark, str(tmp_path / "m"))
    assert st.load()[0].count() == 0
    cells = spark.createDataFrame([("s", 1, 0, [1.0] * 12)], "slide string, label int, `group` int, features array<double>")
    st.save("one", m(1), cells, ["s"])
    st.save("old", m(0))
    st.save("two", m(1), cells)
    usable, stale = st.load()
    assert [r["id"] for r in usable.collect()] == ["two", "one"] and [r["id"] for r in stale.collect()] == ["old"]
    assert st.samples("one").count() == 1
    st.delete("one")
    assert [r["id"] for r in st.load()[0].collect()] == ["two"] and st.samples("one").count() == 0


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("s", "G1", 0.123456789, 0.0, 0.1, 0.98765, 1.234e-12, 0.0, 5, 6)],
                              "slide string, gene string, mean_in double, mean_out double, diff double, auc double, p double, q double, n_in bigint, n_out bigint")
    r = exports.enrichment_rows(d, "roi").first()
    assert (r["mean_in"], r["auc"], r["p"], r["q"]) == ("0.12346", "0.9877", "1.234e-12", "0.000e+0")
    exports.write_csv(exports.enrichment_rows(d, "roi"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    from patchframe.operators import grid
    reg = spark.createDataFrame([("s", 1, 0.0, 0.0, 100.0, 50.0)], "slide string, region_id int, x double, y double, width double, height double")
    P = grid.build_patch_grid(reg, 50)
    docs = exports.patch_manifest(P, grid.grid_meta(reg, 50), max_patches=1).collect()
    got = [json.loads(x["value"]) for x in docs]
    assert len(got) == 2 and {len(g["patches"]) for g in got} == {1} and got[0]["count"] == 2 and got[0]["patchPx0"] == 50
    lines = {x["part"]: json.loads(x["value"]) for x in exports.patch_manifest(P, grid.grid_meta(reg, 50)).collect()}
    assert lines[-1]["count"] == 2 and lines[-1]["patchPx0"] == 50 and lines[1] == {"index": 1, "col": 1, "row": 0, "x": 50, "y": 0}
    f = json.loads(exports.patch_features(P).orderBy("index").first()["feature"])
    assert f["geometry"]["coordinates"][0][2] == [50, 50] and f["properties"]["classification"]["name"] == "Patch"
    sq = grid.patch_squares(P.withColumnRenamed("index", "patch_id"), F.lit("c"))
    assert geo.with_bbox(sq).count() == 2
