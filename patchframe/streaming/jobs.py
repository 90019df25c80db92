"""Structured Streaming forms of three batch behaviours: encode what is unseen, merge
a run once it is whole, keep a document current from its edit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchframe.operators.learn import embed_patches
from patchframe.operators.quantise import merge_shards
from patchframe.sources.stores import SHARD, EmbeddingStore


def stream_embeddings(
    patches: DataFrame, encoder: Callable, store: EmbeddingStore, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Encode patches as they arrive.  ``patches`` has the SHARD columns and patch_key.

    A batch only encodes keys the store lacks, of which it reads the keys in the batch's own
    partitions and no vectors.  A repeated batch writes the same keys again under its own
    batch number, so delivery may be at least once.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["patch_key"])
        store.append(embed_patches(new, encoder, store.keys(new), store.dim).select(*SHARD, "patch_key", "vec"), batch=number + 1)

    w = patches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_shards(
    rows: DataFrame, headers_of: Callable[[DataFrame], DataFrame], staging: str, out: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Merge runs of shards as they become whole.

    ``rows`` is a stream of shard rows (run, shard, of, row, n_rows, …).  See
    :func:`merge_batch`; :func:`read_runs` reads what is merged.
    """
    w = rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, headers_of, staging, out)).option(
        "checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def merge_batch(batch: DataFrame, number: int, headers_of: Callable[[DataFrame], DataFrame], staging: str, out: str) -> None:
    """Stage the shard rows of a batch and write the runs it completes to ``out``.

    Shard headers are derived from the staged rows by ``headers_of``; shards that arrive
    twice are taken once.  A run is one partition of ``out``, overwritten whole, and closed
    by a row (run, rows, batch) in ``<out>-closed`` after that.  A batch that failed half way
    leaves runs open and writes them anew when repeated; closed runs stay as they are.
    """
    spark = batch.sparkSession
    batch.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("run").parquet(staging)
    touched = batch.select("run").distinct()
    staged = spark.read.schema(_with_batch(batch)).parquet(staging).join(touched, "run", "left_semi")
    key = ["run", "shard", "row"]
    once = staged.join(staged.groupBy(*key).agg(F.min("batch").alias("batch")), [*key, "batch"], "left_semi").dropDuplicates(key)
    open_ = once.join(_closed(spark, out), "run", "left_anti")
    merged, _ = merge_shards(open_.drop("of", "n_rows", "batch"), headers_of(open_))
    merged.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run").parquet(out)
    written = _runs(spark, out)
    if written is not None:
        new = written.where(F.col("batch") == number).join(touched, "run", "left_semi").join(_closed(spark, out), "run", "left_anti")
        new.groupBy("run").agg(F.count(F.lit(1)).alias("rows")).withColumn("batch", F.lit(number)).write.mode(
            "append").parquet(f"{out}-closed")


def read_runs(spark: SparkSession, out: str) -> DataFrame:
    """The rows of closed runs; no row and only ``run`` before the first is written."""
    written = _runs(spark, out)
    if written is None:
        return spark.createDataFrame([], "run string")
    return written.join(_closed(spark, out), "run", "left_semi")


def _runs(spark: SparkSession, out: str) -> DataFrame | None:
    """All written rows with ``run`` as text, whatever its partitions look like."""
    from pyspark.sql.types import StringType, StructField, StructType

    try:
        found = spark.read.parquet(out).schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    schema = StructType([StructField("run", StringType()) if f.name == "run" else f for f in found])
    return spark.read.schema(schema).parquet(out)


def _closed(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema("run string, rows bigint, batch int").parquet(f"{out}-closed").select("run").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run string")


def _with_batch(df: DataFrame):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([f for f in df.schema.fields if f.name != "batch"] + [StructField("batch", IntegerType())])


def shard_headers(rows: DataFrame, *keys: str) -> DataFrame:
    """One header per shard from its rows; ``keys`` must agree within a run."""
    return rows.groupBy("run", "shard").agg(
        F.max("of").alias("of"), F.max("n_rows").alias("n_rows"), *[F.max(k).alias(k) for k in keys])


def replay_stream(log: DataFrame) -> DataFrame:
    """Current state per annotation from a stream of edits (slide, id, seq, op, after as JSON).

    State per annotation is its newest entry, whatever order edits arrive in.  Emits
    each annotation that a batch touched, removals too (op = removed); a sink keeps the
    newest row per id.
    """
    newest = F.max(F.struct("seq", "op", "after")).alias("__n")
    return log.groupBy("slide", "id").agg(newest).select("slide", "id", "__n.*")
