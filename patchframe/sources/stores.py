"""Append-only tables for embeddings and models."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchframe.operators.components import cut_lineage
from patchframe.operators.expression import is_small
from patchframe.operators.learn import LinearModel
from patchframe.operators.raster import FEATURE_VERSION, FEATURES

SHARD = ["slide", "model_id", "level", "patch_px"]


class EmbeddingStore:
    """Embeddings by (slide, model, level, patch size), one Parquet partition each.

    Writes only append; the newest vector of a key wins and a cleared shard is a
    marker row, so a job that is repeated after a lost executor does no harm.
    """

    SCHEMA = "patch_key string, vec array<float>, dim int, batch bigint, cleared boolean, slide string, model_id string, level int, patch_px int"

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path, dim

    def _raw(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        """Current vectors.  Rows of another width belong to an older model and are ignored."""
        live = self._live(self._raw(), F.size("vec"))
        return live.groupBy(*SHARD, "patch_key").agg(F.max_by("vec", "batch").alias("vec"))

    def keys(self, of: DataFrame | None = None) -> DataFrame:
        """SHARD columns and patch_key of the current vectors, without reading a vector.

        With ``of`` only from the partitions its SHARD columns name.  Vectors written
        before the store recorded their width are not seen and may be encoded again.
        """
        raw = self._raw().select("patch_key", "dim", "batch", "cleared", *SHARD)
        if of is not None:
            shards = cut_lineage(of.select(*SHARD).distinct())
            raw = raw.join(F.broadcast(shards) if is_small(shards) else shards, SHARD, "left_semi")
        return self._live(raw, F.col("dim")).select(*SHARD, "patch_key").distinct()

    def _live(self, raw: DataFrame, width) -> DataFrame:
        gone = raw.filter("cleared").groupBy(*SHARD).agg(F.max("batch").alias("__gone"))
        return raw.filter(~F.col("cleared") & (width == self.dim)).join(gone, SHARD, "left").filter(
            F.col("__gone").isNull() | (F.col("batch") > F.col("__gone")))

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Add vectors (SHARD columns, patch_key, vec); a wrong width is refused."""
        msg = F.format_string(f"vector of %s has %d values, the store holds {self.dim}", F.col("patch_key"), F.size("vec"))
        checked = F.when(F.size("vec") == self.dim, F.col("vec")).otherwise(F.raise_error(msg).cast("array<float>"))
        self._write(rows.withColumn("vec", checked).withColumn("cleared", F.lit(False)), batch)

    def clear(self, shards: DataFrame, batch: int | None = None) -> None:
        d = shards.select(*SHARD).distinct()
        self._write(d.withColumns({"patch_key": F.lit(None).cast("string"), "vec": F.lit(None).cast("array<float>"),
                                   "cleared": F.lit(True)}), batch)

    def _write(self, rows: DataFrame, batch: int | None) -> None:
        b = batch if batch is not None else time.time_ns()
        rows.withColumns({"batch": F.lit(b), "dim": F.size("vec")}).select("patch_key", "vec", "dim", "batch", "cleared", *SHARD).write.mode(
            "append").partitionBy(*SHARD).parquet(self.path)

    def bytes(self) -> DataFrame:
        return self.read().groupBy(*SHARD).agg(
            F.count(F.lit(1)).alias("vectors"), F.sum(F.size("vec") * F.lit(4)).cast("bigint").alias("bytes"))


class ModelStore:
    """Tissue models newest first, with the cells each was fitted on."""

    MODELS = ("id string, name string, feature_version int, weights array<double>, bias double, mean array<double>, "
              "scale array<double>, trained_at timestamp, tissue bigint, artefact bigint, slides array<string>, deleted boolean")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _models(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.MODELS).parquet(f"{self.path}/models")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.MODELS)

    def save(self, id: str, model: LinearModel, samples: DataFrame | None = None, slides=()) -> None:
        row = (id, model.meta.get("name", id), model.feature_version, model.weights[0], model.bias[0], model.mean,
               model.scale, model.samples["tissue"], model.samples["artefact"], list(slides))
        schema = ("id string, name string, feature_version int, weights array<double>, bias double, mean array<double>, "
                  "scale array<double>, tissue bigint, artefact bigint, slides array<string>")
        d = self.spark.createDataFrame([row], schema).withColumns(
            {"trained_at": F.current_timestamp(), "deleted": F.lit(False)})
        d.write.mode("append").parquet(f"{self.path}/models")
        if samples is not None:
            samples.withColumn("model_id", F.lit(id)).write.mode("append").partitionBy("model_id").parquet(f"{self.path}/samples")

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(usable, stale): stale ones were fitted on another feature layout."""
        m = self._models()
        live = m.filter("not deleted").join(m.filter("deleted").select("id"), "id", "left_anti").orderBy(
            F.desc("trained_at"), "id")
        ok = (F.col("feature_version") == FEATURE_VERSION) & (F.size("weights") == len(FEATURES))
        return live.filter(ok), live.filter(~ok)

    def samples(self, id: str) -> DataFrame:
        m = self._models().filter("deleted").select(F.col("id").alias("model_id"))
        return self.spark.read.parquet(f"{self.path}/samples").filter(F.col("model_id") == id).join(m, "model_id", "left_anti")

    def delete(self, id: str) -> None:
        nothing = self.spark.createDataFrame([], self.MODELS).drop("trained_at", "deleted", "id")
        row = self.spark.range(1).select(F.lit(id).alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in nothing.schema],
                                         F.current_timestamp().alias("trained_at"), F.lit(True).alias("deleted"))
        row.write.mode("append").parquet(f"{self.path}/models")
