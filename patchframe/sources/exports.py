"""Tables for other tools: CSV rows, AnnData-shaped tables, patch manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchframe.functions.scalar import obs_name
from patchframe.operators.expression import beside, decode, is_coded, pack_codes


def fixed_text(c, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double") if isinstance(c, str) else c)


def exponent_text(c, digits: int = 3) -> Column:
    """Scientific notation without padding the exponent: 1.234e-5."""
    return F.regexp_replace(F.format_string(f"%.{digits}e", F.col(c).cast("double")), r"e([+-])0*(\d)", "e$1$2")


def enrichment_rows(df: DataFrame, region: str) -> DataFrame:
    """Rows of the enrichment CSV; the first column says whether genes or modules were compared."""
    head, name = ("gene", "gene") if "gene" in df.columns else ("cell_type", "name")
    return df.select(
        "slide", F.col(name).alias(head), fixed_text("mean_in", 5).alias("mean_in"),
        fixed_text("mean_out", 5).alias("mean_out"), fixed_text("diff", 5).alias("diff"),
        fixed_text("auc", 4).alias("auc"), exponent_text("p").alias("p"), exponent_text("q").alias("q"),
        "n_in", "n_out", F.lit(region).alias("region"))


def gradient_rows(df: DataFrame, axis: str) -> DataFrame:
    head, name = ("gene", "gene") if "gene" in df.columns else ("cell_type", "name")
    return df.select(
        "slide", F.col(name).alias(head), fixed_text("rho", 4).alias("rho"), fixed_text("mean_start", 5).alias("mean_start"),
        fixed_text("mean_end", 5).alias("mean_end"), exponent_text("p").alias("p"), exponent_text("q").alias("q"),
        F.col("n").alias("n_patches"), F.coalesce(fixed_text("length_um", 0), F.lit("")).alias("axis_um"),
        F.lit(axis).alias("axis"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("slide").csv(path, header=True)


def expression_panel(E: DataFrame, panel: dict[str, int], digits: int = 5) -> DataFrame:
    """One row per patch with one column per gene of a panel (gene -> position)."""
    base = [c for c in ("patch_id", "col", "row", "x", "y", "side") if c in E.columns]
    return E.select("slide", *base, *[fixed_text(F.get("values", F.lit(i)).cast("double"), digits).alias(g) for g, i in panel.items()])


def expression_lines(E: DataFrame, G: DataFrame, digits: int = 5) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of the CSV with every gene, as text: a map has too many genes
    to give each a column."""
    names = G.groupBy("slide").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_idx", "gene"))), lambda g: g.gene).alias("g"))
    place = [c for c in ("col", "row") if c in E.columns]
    header = names.select("slide", F.concat_ws(",", F.lit(",".join(["patch", *place, "x,y,size"])), F.concat_ws(",", "g")).alias("value"))
    vals = F.transform("values", lambda v: F.format_string(f"%.{digits}f", v.cast("double")))
    lines = E.select("slide", "patch_id", F.concat_ws(
        ",", F.col("patch_id").cast("string"), *[F.col(c).cast("string") for c in place], F.col("x").cast("string"), F.col("y").cast("string"),
        F.col("side").cast("string"), F.concat_ws(",", vals)).alias("value"))
    return header, lines


def anndata_tables(
    E: DataFrame, G: DataFrame, mask: DataFrame | None = None, genes: DataFrame | None = None,
    provenance: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """obs, var, X, obsm and uns of an annotated matrix, one table each.

    ``genes`` (gene, ordinal) selects genes and sets their order.  Byte-coded maps are
    decoded; patch centres are the coordinates.
    """
    if is_coded(E):
        E = decode(E, G)
    var = G.select("slide", "gene_idx", "gene")
    x = F.col("values")
    X = E
    if genes is not None:
        var = var.join(genes.select("gene", "ordinal"), "gene").select("slide", "gene_idx", "gene", "ordinal")
        pick = var.groupBy("slide").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "gene_idx"))), lambda g: g.gene_idx).alias("__p"))
        X = beside(E, pick)
        x = F.transform("__p", lambda i: F.get(F.col("values"), i))
    name = obs_name("x", "y").alias("obs")
    obs = E.select("slide", "patch_id", name, "x", "y")
    if mask is not None:
        m = mask.select("slide", "patch_id", F.col("in_tissue").cast("int").alias("in_tissue"))
        obs = obs.join(m, ["slide", "patch_id"], "left")
    half = F.col("side") / 2
    out = {
        "obs": obs, "var": var,
        "X": X.select("slide", "patch_id", name, x.cast("array<float>").alias("x_row")),
        "obsm_spatial": E.select("slide", "patch_id", name, F.array(F.col("x") + half, F.col("y") + half).alias("spatial")),
    }
    uns = E.groupBy("slide").agg(F.max("side").cast("string").alias("patch_side_px")).withColumns({
        "units": F.lit("level-0 slide pixels"), "provenance": F.lit("model output, unmeasured")})
    out["uns"] = uns if provenance is None else uns.join(provenance, "slide", "left")
    return out


def write_anndata(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("slide").parquet(f"{path}/{name}")


def write_quantised(E8: DataFrame, G8: DataFrame, path: str) -> None:
    """The byte-coded map, codes packed in a binary, and its gene table."""
    packed = E8 if E8.schema["values"].dataType.typeName() == "binary" else pack_codes(E8)
    packed.write.mode("overwrite").partitionBy("slide").parquet(f"{path}/expression")
    G8.write.mode("overwrite").partitionBy("slide").parquet(f"{path}/genes")


def patch_manifest(P: DataFrame, meta: DataFrame, max_patches: int | None = None) -> DataFrame:
    """``slide, region_id, part, value``: the grid as JSON.

    ``P`` has slide, region_id, index, col, row, x, y; ``meta`` the grid's fields per
    region (see :func:`grid.grid_meta`).  There is one line with the header (part -1) and
    one per patch (part = its index), whatever their number.  ``max_patches`` asks for
    documents over ranges of that many patches instead, each with the full header.
    """
    keys = ["slide", "region_id"]
    total = P.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    m = meta.select(*keys, *[c for c in ("mpp", "level", "downsample") if c in meta.columns],
                    F.col("patch_px").alias("patchPx"), F.col("side").alias("patchPx0"),
                    F.col("patch_um").alias("patchUm"), "cols", "rows")
    if max_patches is None:
        head = m.join(total, keys)
        head = head.select(*keys, F.lit(-1).cast("bigint").alias("part"), F.to_json(F.struct(*[c for c in head.columns if c != "region_id"])).alias("value"))
        return head.unionByName(P.select(
            *keys, F.col("index").cast("bigint").alias("part"), F.to_json(F.struct("index", "col", "row", "x", "y")).alias("value")))
    d = P.withColumn("part", F.floor(F.col("index") / max_patches).cast("int"))
    body = d.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("index", "col", "row", "x", "y"))).alias("patches"))
    doc = body.join(m, keys).join(total, keys)
    fields = [c for c in doc.columns if c not in ("region_id", "part")]
    return doc.select(*keys, "part", F.to_json(F.struct(*fields)).alias("value"))


def patch_features(P: DataFrame, extra_key: str = "patchframe") -> DataFrame:
    """The same squares as GeoJSON features, to look at beside the slide."""
    x0, y0 = F.col("x").cast("string"), F.col("y").cast("string")
    x1, y1 = (F.col("x") + F.col("side")).cast("string"), (F.col("y") + F.col("side")).cast("string")
    pt = lambda a, b: F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    ring = F.concat_ws(",", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    # Fixed value: the grey other viewers expect for a patch square.
    props = F.to_json(F.struct(
        F.lit("annotation").alias("objectType"),
        F.struct(F.lit("Patch").alias("name"), F.lit(-8355712).alias("colorRGB")).alias("classification"),
        F.struct("index", "col", "row").alias(extra_key)))
    return P.select("slide", "index", F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit(']]},"properties":'), props, F.lit("}")
    ).alias("feature"))
