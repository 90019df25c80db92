"""Views of an expression map: one row per patch, one array slot per gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut_lineage
from .halves import unpack_halves


SMALL_BYTES = 32 << 20  # size up to which a table is broadcast to a map
SALTS = 64


def is_small(written: DataFrame, small_bytes: int = SMALL_BYTES) -> bool:
    """Does a written table take at most ``small_bytes`` in memory.

    Files tell what surely is too large; the rest is measured as the text of its rows,
    which is about as long as the rows or longer.
    """
    if int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > small_bytes:
        return False
    size = written.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"]
    return (size or 0) <= small_bytes


def with_rows(E: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join a narrow table of patch keys to a map: the map stays where it lies while the
    narrow side is small, beyond that both meet on the keys, which no slide makes hot."""
    keyed = cut_lineage(keyed)
    return E.join(F.broadcast(keyed) if is_small(keyed, small_bytes) else keyed, on, how)


def beside(E: DataFrame, small: DataFrame, how: str = "inner", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join a per-slide table to a map on ``slide`` without gathering a slide's rows.

    The small side is written and measured.  Up to ``small_bytes`` it is broadcast, so the
    map stays where it lies; beyond that its rows are repeated under SALTS keys a slide,
    over which the slide's patches are spread by their own hash.
    """
    small = cut_lineage(small)
    if is_small(small, small_bytes):
        return E.join(F.broadcast(small), "slide", how)
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = E.withColumn("__salt", F.pmod(F.xxhash64("patch_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["slide", "__salt"], how).drop("__salt")


def as_arrays(E: DataFrame) -> DataFrame:
    """The map with its values as arrays, whatever its layout."""
    if "halves" in E.columns:
        return unpack_halves(E)
    return unpack_codes(E) if E.schema["values"].dataType.typeName() == "binary" else E


def decode(E: DataFrame, G: DataFrame) -> DataFrame:
    """Byte codes to values: ``code * scale + zero`` with each gene's own pair."""
    E = as_arrays(E)
    per_slide = G.groupBy("slide").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("gene_idx", "scale", "zero"))),
            lambda s: F.struct(s.scale.alias("m"), s.zero.alias("c")),
        ).alias("__sz")
    )
    return (
        beside(E, per_slide)
        .withColumn(
            "values",
            F.zip_with("values", "__sz", lambda v, s: (v * s.m + s.c).cast("float")),
        )
        .select(*E.columns)
    )


def long_values(E: DataFrame, *extra: str) -> DataFrame:
    """One row per (patch, gene).  A view to aggregate from, never to store."""
    return as_arrays(E).select("slide", "patch_id", *extra, F.posexplode("values").alias("gene_idx", "value"))


def gene_values(E: DataFrame, G: DataFrame, gene: str) -> DataFrame:
    """One gene over every patch; null on slides whose map does not have it.

    Byte codes come back as values where the gene has a scale.
    """
    E = unpack_halves(E) if "halves" in E.columns else E
    at = G.filter(F.col("gene") == gene).groupBy("slide").agg(F.min(F.struct("gene_idx", "scale", "zero")).alias("__g"))
    value = F.get("values", F.col("__g.gene_idx"))
    if is_coded(E):
        value = F.coalesce((value * F.col("__g.scale") + F.col("__g.zero")).cast("float"), value.cast("float"))
    return beside(as_arrays(E).select("slide", "patch_id", "values"), at, "left").select("slide", "patch_id", value.alias("value"))


def current_field(E, G, gene: str | None = None, signature: DataFrame | None = None) -> DataFrame:
    """The field to draw or threshold: a gene, or a module's score, with its label."""
    if signature is not None:
        from .signatures import score_signatures

        s = score_signatures(E, G, signature)
        return s.select("slide", "patch_id", F.col("score").alias("value"), F.col("name").alias("label"))
    if gene is None:
        raise ValueError("name a gene or give a signature")
    return gene_values(E, G, gene).withColumn("label", F.lit(gene))


def survey_genes(E: DataFrame) -> DataFrame:
    """Mean, population sd, range and count per gene in one pass, of any layout of a map.

    Each task hands on one row per slide, gene and Arrow batch: count, mean, squared
    deviations from it, least and greatest.  Those merge exactly; values are not exploded.
    A missing value counts in ``n`` and nowhere else.
    """

    def survey(batches):
        names = ["slide", "gene_idx", "rows", "n", "mean", "m2", "lo", "hi"]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slides, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            cuts = np.flatnonzero(slides[1:] != slides[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(slides)]):
                part = column.slice(lo, hi - lo)
                if pa.types.is_binary(part.type) or pa.types.is_large_binary(part.type):
                    block, there = _code_block(part).astype(np.float64), None
                else:
                    flat = part.flatten()
                    there = np.asarray(flat.is_valid()).reshape(hi - lo, -1) if flat.null_count else None
                    block = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(hi - lo, -1).astype(np.float64)
                ok = np.ones(block.shape, bool) if there is None else there
                n = ok.sum(axis=0)
                mean = np.where(ok, block, 0).sum(axis=0) / np.maximum(n, 1)
                m2 = np.where(ok, (block - mean) ** 2, 0).sum(axis=0)
                ends = np.where(ok, block, np.inf).min(axis=0), np.where(ok, block, -np.inf).max(axis=0)
                genes = np.arange(block.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slides[lo]] * len(genes), pa.string()), pa.array(genes), pa.array(np.full(len(genes), hi - lo)), pa.array(n),
                     pa.array(mean), pa.array(m2), *[pa.array(e, mask=n == 0) for e in ends]], names)

    parts = E.select("slide", "values").where("values IS NOT NULL").mapInArrow(
        survey, "slide string, gene_idx int, rows bigint, n bigint, mean double, m2 double, lo double, hi double")
    # Chan's merge: a first mean, then deviations from it, so nothing cancels.
    keys = ["slide", "gene_idx"]
    g = parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum("m2").alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("n", "mean")).alias("parts"))
    apart = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return g.select(*keys, "mean", F.sqrt((F.col("m2") + apart) / F.col("n")).alias("sd"), "lo", "hi", F.col("rows").alias("n"))


def is_coded(E: DataFrame) -> bool:
    """Does the map hold byte codes: packed in a binary, or as small integers."""
    if "halves" in E.columns:
        return False
    kind = E.schema["values"].dataType
    return kind.typeName() == "binary" or kind.elementType.typeName() in ("short", "byte", "integer")


def _code_block(column: pa.Array) -> np.ndarray:
    """Rows x genes of codes from a column of binaries or lists, without copying values."""
    n = len(column)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    else:
        data = column.flatten().to_numpy(zero_copy_only=False)
    return data.reshape(n, -1)


def pack_codes(E8: DataFrame) -> DataFrame:
    """Byte codes as one binary per patch.

    A binary moves between Spark and Python as one copy, a list element by element, so
    this is the layout to store large coded maps in.
    """
    rest = [c for c in E8.columns if c != "values"]

    def pack(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            block = np.ascontiguousarray(_code_block(b.column(len(rest))), np.uint8)
            offsets = np.arange(0, block.size + 1, block.shape[1], dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(block)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=[*rest, "values"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in E8.schema if f.name != "values")
    return E8.select(*rest, "values").mapInArrow(pack, f"{kinds}, values binary")


def unpack_codes(E: DataFrame) -> DataFrame:
    """A packed map as small integers, for the operators that look at single genes."""
    rest = [c for c in E.columns if c != "values"]

    def unpack(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            block = _code_block(b.column(len(rest))).astype(np.int16)
            offsets = pa.array(np.arange(0, block.size + 1, block.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*rest, "values"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in E.schema if f.name != "values")
    return E.select(*rest, "values").mapInArrow(unpack, f"{kinds}, values array<smallint>")


def code_histogram(E: DataFrame, bins: int = 256) -> DataFrame:
    """``slide, gene_idx, code, n_in, n_out`` of a byte-coded map with a boolean
    ``inside`` column.

    Each task counts codes of whole Arrow batches into one genes x codes table and
    hands on only its occupied cells, so what is shuffled is bounded by
    tasks x genes x 256 and no value is ever sorted.
    """

    def count(batches):
        slide, table = None, None

        def flush():
            side, gene, code = np.nonzero(table)
            n = table[side, gene, code]
            return pa.RecordBatch.from_pydict(
                {
                    "slide": pa.array([slide] * len(gene), pa.string()),
                    "gene_idx": pa.array(gene.astype(np.int32)),
                    "code": pa.array(code.astype(np.int32)),
                    "n_in": pa.array(np.where(side == 1, n, 0).astype(np.int64)),
                    "n_out": pa.array(np.where(side == 0, n, 0).astype(np.int64)),
                }
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            slides = batch.column(0).to_numpy(zero_copy_only=False)
            inside = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            block = _code_block(batch.column(2))
            genes = block.shape[1]
            cuts = np.flatnonzero(slides[1:] != slides[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(slides)]):
                here = slides[lo]
                if table is None or here != slide or table.shape[1] != genes:
                    if table is not None:
                        yield flush()
                    slide, table = here, np.zeros((2, genes, bins), np.int64)
                for side in (0, 1):
                    rows = block[lo:hi][inside[lo:hi] == bool(side)]
                    for g0 in range(0, genes, 64) if len(rows) else ():
                        part = rows[:, g0 : g0 + 64]
                        wide = part.shape[1]
                        key = part + np.arange(0, wide * bins, bins, dtype=np.intp)
                        table[side, g0 : g0 + 64] += np.bincount(key.ravel(), minlength=wide * bins).reshape(wide, bins)
        if table is not None:
            yield flush()

    partial = E.select("slide", F.col("inside"), "values").mapInArrow(
        count, "slide string, gene_idx int, code int, n_in bigint, n_out bigint"
    )
    return partial.groupBy("slide", "gene_idx", "code").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")
    )


def tissue_masked(E: DataFrame, regions: DataFrame) -> DataFrame:
    """Mark patches on tissue for display; every patch stays and no value changes."""
    from .joins import flag_inside

    return flag_inside(E, regions, "in_tissue")
