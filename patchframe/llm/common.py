"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster
    without it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="patchframe-llm-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stage_path = path
    return back


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage`."""
    path = getattr(df, "stage_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 2000, bytes_: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length and size from row tuples."""
    buf: list[tuple] = []
    weight = 0

    def out():
        cols = list(zip(*buf))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for r in rows:
        buf.append(r)
        weight += sum(len(x) for x in r if isinstance(x, (bytes, str, list, np.ndarray)))
        if len(buf) >= size or weight >= bytes_:
            yield out()
            buf, weight = [], 0
    if buf:
        yield out()


BATCH_ROWS = 2000


def long_texts(spark: SparkSession) -> SparkSession:
    """Let the session send rows to Python in batches fit for texts: at most BATCH_ROWS at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def blank(c) -> F.Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(c if not isinstance(c, str) else F.col(c), F.lit(""))
