"""Column layouts of the tables the operators take."""

from __future__ import annotations

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"

EXPRESSION = (
    "slide string, patch_id bigint, x bigint, y bigint, side int, values array<float>"
)
EXPRESSION_CODES = (
    "slide string, patch_id bigint, x bigint, y bigint, side int, values array<smallint>"
)
GENES = "slide string, gene_idx int, gene string, scale float, zero float"
SIGNATURES = "sig_idx int, name string, gene string, weight double, cells bigint"
ANNOTATIONS = (
    "slide string, id string, geom_type string, polygons " + GEOMETRY + ", class_id string, "
    "object_type string, source string, model_id string, confidence double, roi_id string, "
    "locked boolean, name string, measurements map<string,double>, "
    "created_at timestamp, updated_at timestamp, "
    "minx double, miny double, maxx double, maxy double"
)
CLASSES = "ordinal int, class_id string, name string, color int"
CELLS = "slide string, x int, y int, r int, g int, b int"
SLIDES = (
    "slide string, mpp double, "
    "levels array<struct<level:int,width:bigint,height:bigint,downsample:double>>, "
    "bounds struct<x:double,y:double,width:double,height:double>"
)
EMBEDDINGS = (
    "slide string, model_id string, level int, patch_px int, patch_key string, vec array<float>"
)

# Reserved class ids.
ROI_CLASS = "__roi__"
AXIS_CLASS = "__axis__"
