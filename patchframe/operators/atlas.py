"""Cell-type signatures from a labelled single-cell atlas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Symbols that say nothing about a cell type.
UNINFORMATIVE_GENES = (
    r"^(MT-"
    r"|MT(ATP|CO|CYB|ND|RNR)[0-9]"
    r"|RP[SL][0-9P]|RPSA$"
    r"|MRP[SL][0-9]"
    r"|ENSG[0-9]|LINC[0-9-]"
    r"|MALAT1$|NEAT1$|XIST$|EEF1[AG][0-9]?$|TMSB4X$|B2M$|ACTB$|GAPDH$)"
)


def is_informative(gene: str = "gene") -> Column:
    return ~F.col(gene).rlike(UNINFORMATIVE_GENES)


def read_atlas(spark, obs_path: str, counts_path: str, tissue: str, diseases=()):
    """(obs, counts): primary cells of one tissue, and their long counts.  Both
    predicates reach the Parquet scan."""
    obs = spark.read.parquet(obs_path).filter((F.col("tissue") == tissue) & F.col("is_primary"))
    if diseases:
        obs = obs.filter(F.col("disease").isin(*diseases))
    return obs, spark.read.parquet(counts_path).join(obs.select("cell_id"), "cell_id", "left_semi")


def sample_cells(obs: DataFrame, per_type: int | None = None, min_cells: int = 200, order: Column | None = None,
                 seed: int = 0) -> DataFrame:
    """The cells of each type with enough of them; all, unless a sample is asked for.

    A sample of ``per_type`` cells is the ``per_type`` smallest hashes.  A type's cells are first reduced
    to the best of each of 256 hash groups, so one very large type is not ordered by
    a single task.
    """
    key = order if order is not None else F.xxhash64(F.col("cell_id"), F.lit(seed))
    sizes = obs.groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") >= min_cells)
    if per_type is None:
        return obs.join(sizes, "cell_type").select("cell_id", "cell_type", "cells")
    d = obs.join(sizes, "cell_type").withColumn("__k", key).withColumn("__g", F.pmod(F.hash("cell_id"), F.lit(256)))
    ranked = lambda by: F.row_number().over(W.partitionBy(*by).orderBy("__k", "cell_id"))
    return (
        d.withColumn("__r", ranked(["cell_type", "__g"])).filter(F.col("__r") <= per_type)
        .withColumn("__r", ranked(["cell_type"])).filter(F.col("__r") <= per_type)
        .select("cell_id", "cell_type", F.least("cells", F.lit(per_type).cast("bigint")).alias("cells"))
    )


def type_means(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean of log1p(counts per ten thousand) per type and gene; absent counts are zeros."""
    used = counts.join(cells, "cell_id")
    used = used.withColumn("__depth", F.sum("n").over(W.partitionBy("cell_id")))
    size = cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("__cells"))
    logged = F.log1p(F.col("n") * 1e4 / F.when(F.col("__depth") != 0, F.col("__depth")).otherwise(1))
    return (
        used.groupBy("cell_type", "gene", "cells")
        .agg(F.sum(logged).alias("__sum"))
        .join(size, "cell_type")
        .select("cell_type", "gene", "cells", (F.col("__sum") / F.col("__cells")).alias("mean"))
    )


def atlas_signatures(
    obs: DataFrame, counts: DataFrame, top: int = 40, per_type: int | None = None, min_cells: int = 200,
    min_genes: int = 5, order: Column | None = None, seed: int = 0, decimals: int = 4,
) -> DataFrame:
    """``sig_idx, name, gene, weight, cells, rank``: each type's most specific genes.

    A gene is compared with the mean of the *other types' means*, must be expressed
    (mean > 0.1) and higher here; uninformative symbols go before the ranking.
    """
    cells = sample_cells(obs, per_type, min_cells, order, seed)
    types = cells.select("cell_type").distinct()
    t = types.agg(F.count(F.lit(1)).alias("__t"))
    numbered = types.withColumn("sig_idx", F.row_number().over(W.orderBy("cell_type")) - 1)
    m = type_means(cells, counts)
    all_types = m.groupBy("gene").agg(F.sum("mean").alias("__all"))
    lfc = F.col("mean") - (F.col("__all") - F.col("mean")) / (F.col("__t") - 1)
    w = W.partitionBy("cell_type").orderBy(F.desc("lfc"), "gene")
    per = W.partitionBy("cell_type")
    return (
        m.join(all_types, "gene").join(t).filter(F.col("__t") > 1)
        .withColumn("lfc", lfc)
        .filter((F.col("mean") > 0.1) & (F.col("lfc") > 0) & is_informative())
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
        .withColumn("__n", F.count(F.lit(1)).over(per))
        .filter(F.col("__n") >= min_genes)
        .join(numbered, "cell_type")
        .select(
            "sig_idx", F.col("cell_type").alias("name"), "gene",
            F.round("lfc", decimals).alias("weight"), "cells", "rank",
        )
    )


def signature_genes(S: DataFrame) -> DataFrame:
    """Distinct genes of a signature table: what a model has to cover."""
    return S.select("gene").distinct()
