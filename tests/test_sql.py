from patchframe.functions import geometry as geo
from patchframe.functions import scalar
from patchframe.functions.sql import register_functions
from pyspark.sql import functions as F


def test_sql_functions_equal_the_expressions(spark):
    register_functions(spark)
    ring = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    shape = [[ring((0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]]
    d = spark.createDataFrame([(shape, x * 0.9, y * 1.1) for x in range(-1, 13) for y in range(-1, 11)],
                              f"polygons {geo.GEOMETRY_TYPE}, x double, y double")
    d = d.select(
        F.expr("contains_point(polygons, x, y)").alias("a"), geo.contains_point("polygons", "x", "y").alias("b"),
        F.expr("normal_sf(x)").alias("p"), scalar.normal_sf("x").alias("q"))
    rows = d.collect()
    assert all(r["a"] == r["b"] and abs(r["p"] - r["q"]) < 1e-12 for r in rows)
    assert {r["a"] for r in rows} == {True, False}


def test_class_ids_stay_unique(spark):
    from patchframe.operators.annotations import ensure_classes

    have = spark.createDataFrame([(0, "b", "B")], "ordinal int, class_id string, name string")
    names = spark.createDataFrame([("foo", 1), ("Foo!", 2), ("Foo 2", 3), (" b ", 4), ("B?", 5), ("FOO", 6)], "name string, seq int")
    got = {r["name"]: r["class_id"] for r in ensure_classes(names, have).collect()}
    assert got == {"B": "b", "foo": "foo", "Foo!": "foo-2", "Foo 2": "foo-2-2", "B?": "b-2"}
