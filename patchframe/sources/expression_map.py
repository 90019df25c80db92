"""Reading expression-map containers in parallel byte ranges.

A container is: 8 magic bytes, a little-endian uint32 header length, a JSON header,
then patches x genes values row by row.  Rows have a fixed width, so any range of rows
can be read alone; one file may be far larger than a task's memory.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The container's magic and the names of its value types.
MAGIC = b"SCEXPR1\x00"
DTYPES = {"float16": "<f2", "float32": "<f4", "uint8": "|u1"}

HEADER = (
    "path string, slide string, side int, dtype string, model string, model_id string, source string, "
    "created_at string, mpp double, shard int, of int, n_rows bigint, n_genes int, header_end bigint, "
    "genes array<string>, scale array<float>, zero array<float>, error string"
)


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _header(f) -> tuple[dict, int]:
    head = f.read_at(12, 0)
    if len(head) < 12:
        raise ValueError(f"{len(head)} bytes: no room for magic and length")
    if head[:8] != MAGIC:
        raise ValueError(f"magic is {head[:8]!r}")
    length = struct.unpack("<I", head[8:])[0]
    if 12 + length > f.size():
        raise ValueError(f"header ends at {12 + length}, file at {f.size()}")
    return json.loads(f.read_at(length, 12)), 12 + length


def _describe(path: str) -> dict:
    with _open(path) as f:
        h, end = _header(f)
        rows, genes = len(h.get("patches") or []), len(h.get("genes") or [])
        if not rows or not genes:
            raise ValueError(f"{rows} patches and {genes} genes in the header")
        dtype = h.get("dtype", "float16")
        if dtype not in DTYPES:
            raise ValueError(f"dtype {dtype} is none of {sorted(DTYPES)}")
        got = (f.size() - end) // np.dtype(DTYPES[dtype]).itemsize
        if got != rows * genes:
            raise ValueError(f"{rows} x {genes} values expected, {got} stored")
        if dtype == "uint8":
            for k in ("scale", "zero"):
                if len(h.get(k) or []) != genes:
                    raise ValueError(f"{k}: {len(h.get(k) or [])} entries for {genes} genes")
    shard = h.get("shard") or [None, None]
    return {
        "path": path, "slide": h.get("slide"), "side": h["side"], "dtype": dtype, "model": h.get("model"),
        "model_id": h.get("modelId") or "precomputed", "source": h.get("source"), "created_at": h.get("createdAt"),
        "mpp": h.get("mpp"), "shard": shard[0], "of": shard[1], "n_rows": rows, "n_genes": genes,
        "header_end": end, "genes": h["genes"], "scale": h.get("scale"), "zero": h.get("zero"), "error": None,
    }


def read_headers(spark: SparkSession, paths: DataFrame | list[str]) -> DataFrame:
    """One row per file; a file that is no valid map has only path and ``error``.

    Headers are read by the executors, one file to a partition where there are few.
    """
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    def arrow(batches):
        schema = pa.schema([
            ("path", pa.string()), ("slide", pa.string()), ("side", pa.int32()), ("dtype", pa.string()),
            ("model", pa.string()), ("model_id", pa.string()), ("source", pa.string()), ("created_at", pa.string()),
            ("mpp", pa.float64()), ("shard", pa.int32()), ("of", pa.int32()), ("n_rows", pa.int64()),
            ("n_genes", pa.int32()), ("header_end", pa.int64()), ("genes", pa.list_(pa.string())),
            ("scale", pa.list_(pa.float32())), ("zero", pa.list_(pa.float32())), ("error", pa.string()),
        ])
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append(_describe(path))
                except (ValueError, KeyError, OSError) as e:
                    rows.append({**dict.fromkeys(schema.names), "path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.select("path").mapInArrow(arrow, HEADER)


def read_expression_maps(
    spark: SparkSession, paths: DataFrame | list[str], rows_per_partition: int = 4000, on_bad: str = "error",
    codes: bool | str = False,
) -> tuple[DataFrame, DataFrame]:
    """(E, G) of a set of containers.

    Each task reads one range of rows.  Halves are widened on the way in.  With
    ``codes`` the files must be uint8 and come back as small integers (or, with
    ``"packed"``, as one binary per patch, the layout for large maps) with scale and
    zero in the gene table; otherwise byte codes are decoded.  With ``"halves"`` the files
    must be float16 and keep their bytes in ``halves binary`` instead of ``values``.  Bad files raise, or are
    left out with ``on_bad="skip"`` (:func:`read_headers` lists them).
    """
    h = read_headers(spark, paths)
    if on_bad == "skip":
        h = h.filter("error is null")
    else:
        msg = F.concat_ws(": ", "path", "error")
        h = h.withColumn("path", F.when(F.col("error").isNotNull(), F.raise_error(msg)).otherwise(F.col("path")))
    halves = codes == "halves"
    if codes:
        need = "float16" if halves else "uint8"
        wrong = F.raise_error(F.concat(F.col("path"), F.lit(f": not a {need} map")))
        h = h.withColumn("path", F.when(F.col("dtype") == need, F.col("path")).otherwise(wrong))
    n = int(rows_per_partition)
    ranges = h.select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1, F.lit(n).cast("bigint"))).alias("first"),
        "n_rows",
    ).withColumn("count", F.least(F.lit(n).cast("bigint"), F.col("n_rows") - F.col("first")))
    # Spread the ranges: the value blocks are read after this small shuffle.
    ranges = ranges.repartition("path", "first")
    kind, np_kind, arrow_kind = (("smallint", np.int16, pa.int16()) if codes else ("float", np.float32, pa.float32()))
    packed = codes in ("packed", "halves")
    column_name = "halves" if halves else "values"
    schema = pa.schema([
        ("slide", pa.string()), ("patch_id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()),
        ("side", pa.int32()), (column_name, pa.binary() if packed else pa.list_(arrow_kind)),
    ])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    head, end = _header(f)
                    genes = len(head["genes"])
                    dt = np.dtype(DTYPES[head.get("dtype", "float16")])
                    lo, k = r["first"], r["count"]
                    # A block of at most about 32 MB at a time.
                    step = max(1, (32 << 20) // (genes * 4))
                    for a in range(lo, lo + k, step):
                        m = min(step, lo + k - a)
                        raw = f.read_at(m * genes * dt.itemsize, end + a * genes * dt.itemsize)
                        v = np.frombuffer(raw, dt).reshape(m, genes)
                        if dt == np.uint8 and not codes:
                            v = v * np.asarray(head["scale"], np.float32) + np.asarray(head["zero"], np.float32)
                        at = head["patches"][a : a + m]
                        offsets = np.arange(0, (m + 1) * genes, genes, dtype=np.int32)
                        if packed:
                            offsets *= dt.itemsize
                            column = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                        else:
                            flat = np.ascontiguousarray(v, np_kind).ravel()
                            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, arrow_kind))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([head.get("slide")] * m, pa.string()),
                                pa.array(np.arange(a, a + m, dtype=np.int64)),
                                pa.array([int(p["x"]) for p in at], pa.int64()),
                                pa.array([int(p["y"]) for p in at], pa.int64()),
                                pa.array([int(head["side"])] * m, pa.int32()),
                                column,
                            ],
                            schema=schema,
                        )

    E = ranges.select("path", "first", "count").mapInArrow(
        read, "slide string, patch_id bigint, x bigint, y bigint, side int, "
        + f"`{column_name}` " + ("binary" if packed else f"array<{kind}>")
    )
    G = h.select(
        "slide", "scale", "zero", F.posexplode("genes").alias("gene_idx", "gene")
    ).select("slide", "gene_idx", "gene", F.get("scale", F.col("gene_idx")).alias("scale"),
             F.get("zero", F.col("gene_idx")).alias("zero"))
    return E, G
