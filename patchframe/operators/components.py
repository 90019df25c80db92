"""Connected components, growth and holes on cell masks.

Cells are shuffled once, into tiles of 256 x 256: a row per tile, its cells packed.
From then on only borders travel.  Components come from the tiles' own labels and a
graph of label pairs that touch across a border, solved apart from the cells.  Growth
settles the tiles whose surroundings changed, against the border keys of their
neighbours, until none changes.  Either way the cells are written twice, the packed
tiles and the result, however far a shape winds.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256
NONE = np.iinfo(np.int64).max
DISTANCE = 1 << 40
LABEL_MASK = DISTANCE - 1
ROW = 1 << 20  # scan positions per row of cells
SMALL_LINKS = 100_000  # links of a round whose look-ups may be broadcast


def stage_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="patchframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    A written table is computed once, survives lost executors, and is planned with its
    real size.
    """
    path = f"{stage_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stage_path = path
    return back


def drop_stage(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by :func:`cut_lineage` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stage_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it.

    The planner goes by the size of files, and those of cells and labels are up to fifty
    times smaller than their rows in memory.
    """
    return df.hint("merge")


def _settle(grid: np.ndarray, open_: np.ndarray, step: int) -> np.ndarray:
    """Smallest reachable key + step * moves for each open cell of one tile."""
    while True:
        best = grid.copy()
        for axis in (0, 1):
            for shift in (1, -1):
                moved = np.roll(grid, shift, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if shift == 1 else -1
                moved[tuple(edge)] = NONE
                if step:
                    moved = np.where(moved == NONE, NONE, moved + step)
                np.minimum(best, moved, out=best)
        best = np.where(open_, best, grid)
        if np.array_equal(best, grid):
            return grid
        if step == 0:
            best = _run_minimum(best, open_)
        grid = best


def _run_minimum(grid: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Give every horizontal and vertical run of open cells its minimum at once."""
    for _ in range(2):
        flat, on = grid.ravel(), open_.ravel()
        width = grid.shape[1]
        start = on.copy()
        start[1:] &= ~on[:-1]
        start[::width] = on[::width]
        at = np.flatnonzero(start)
        if len(at):
            ids = np.cumsum(start) - 1
            low = np.full(len(at), NONE, np.int64)
            np.minimum.at(low, ids[on], flat[on])
            flat = flat.copy()
            flat[on] = low[ids[on]]
        grid, open_ = flat.reshape(grid.shape).T.copy(), open_.T.copy()
    return grid


TILE_KEY = ["slide", "tx", "ty"]
PACKED = "slide string, tx int, ty int, pos binary, key binary"
BORDER = "slide string, tx int, ty int, x int, y int, key bigint"


def _grid(pos: np.ndarray, key: np.ndarray, tile: int, halo=None, tx: int = 0, ty: int = 0):
    """Keys and open cells of a tile, as far as its cells reach, within a frame one cell wide for the neighbours' border keys."""
    y, x = pos // tile, pos % tile
    y0, x0 = int(y.min()) - 1, int(x.min()) - 1
    gy, gx = y - y0, x - x0
    shape = int(gy.max()) + 2, int(gx.max()) + 2
    grid = np.full(shape, NONE, np.int64)
    open_ = np.zeros(shape, bool)
    grid[gy, gx] = key
    open_[gy, gx] = True
    for h in halo if halo is not None else ():
        hy, hx = h["y"] - ty * tile - y0, h["x"] - tx * tile - x0
        if 0 <= hy < shape[0] and 0 <= hx < shape[1]:  # others touch no cell of the tile
            grid[hy, hx] = h["key"]
    return grid, open_, gy, gx


def pack_tiles(cells: DataFrame, step: int, tile: int) -> DataFrame:
    """One row per tile: positions and keys of its cells, settled on their own.  The one shuffle of cells."""
    tx, ty = F.floor(F.col("x") / tile).cast("int"), F.floor(F.col("y") / tile).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        pos = (pdf["y"].to_numpy() - y0 * tile) * tile + pdf["x"].to_numpy() - x0 * tile
        grid, open_, gy, gx = _grid(pos, pdf["key"].to_numpy(), tile)
        key = _settle(grid, open_, step)[gy, gx]
        return pd.DataFrame({"slide": [pdf["slide"].iloc[0]], "tx": np.int32([x0]), "ty": np.int32([y0]),
                             "pos": [pos.astype(np.uint32).tobytes()], "key": [key.astype(np.int64).tobytes()]})

    own = cells.select("slide", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "key", tx.alias("tx"), ty.alias("ty"))
    return own.groupBy(*TILE_KEY).applyInPandas(pack, PACKED)


def _unpacked(make, tile: int):
    """For ``mapInPandas``: rows that ``make(tile row, positions, keys)`` gives for the packed tiles, those of small tiles together."""
    def joined(parts):
        size = [len(pos) for _, pos, _ in parts]
        pos, key = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        slide, tx, ty = (np.repeat(np.array([p[0][c] for p in parts], t), size) for c, t in (("slide", object), ("tx", np.int32), ("ty", np.int32)))
        return pd.DataFrame({
            "slide": slide, "tx": tx, "ty": ty, "x": (pos % tile + tx.astype(np.int64) * tile).astype(np.int32),
            "y": (pos // tile + ty.astype(np.int64) * tile).astype(np.int32), "key": key,
        })

    def run(batches):
        for b in batches:
            parts, cells = [], 0
            for r in b.to_dict("records"):
                pos, key = np.frombuffer(r["pos"], np.uint32).astype(np.int64), np.frombuffer(r["key"], np.int64)
                parts.append((r, *make(r, pos, key)))
                cells += len(parts[-1][1])
                if cells >= TILE * TILE:
                    yield joined(parts)
                    parts, cells = [], 0
            if parts:
                yield joined(parts)
    return run


def _edge_of(pos: np.ndarray, key: np.ndarray, tile: int):
    x, y = pos % tile, pos // tile
    on = (x == 0) | (y == 0) | (x == tile - 1) | (y == tile - 1)
    return pos[on], key[on]


def _borders(tiles: DataFrame, tile: int) -> DataFrame:
    """The cells on the tiles' borders, about a sixtieth of all."""
    return tiles.mapInPandas(_unpacked(lambda r, pos, key: _edge_of(pos, key, tile), tile), BORDER)


def _across(border: DataFrame, tile: int) -> DataFrame:
    """Border cells as the neighbouring tiles see them: ``tx, ty`` is the neighbour, ``nx, ny`` its cell that touches."""
    x, y, tx, ty = (F.col(c) for c in ("x", "y", "tx", "ty"))
    side = lambda on, dx, dy: F.when(on, F.struct((tx + dx).alias("tx"), (ty + dy).alias("ty"), (x + dx).alias("nx"), (y + dy).alias("ny")))
    sides = F.filter(F.array(
        side(F.pmod(x, F.lit(tile)) == 0, -1, 0), side(F.pmod(x, F.lit(tile)) == tile - 1, 1, 0),
        side(F.pmod(y, F.lit(tile)) == 0, 0, -1), side(F.pmod(y, F.lit(tile)) == tile - 1, 0, 1),
    ), lambda s: s.isNotNull())
    return border.withColumn("s", F.explode(sides)).select(
        "slide", "x", "y", "key", F.col("s.tx").alias("tx"), F.col("s.ty").alias("ty"), F.col("s.nx").alias("nx"), F.col("s.ny").alias("ny"))


def linked_roots(links: DataFrame) -> DataFrame:
    """``slide, v, root``: the smallest vertex that each vertex of ``links (slide, a, b)`` reaches.

    Every round vertices point to their smallest neighbour, pointers are followed twice and
    the graph is contracted, so a path loses three of four vertices a round.  Minima have
    map-side combine and look-ups join on a unique side.
    """
    E = cut_lineage(links.filter("a <> b").select("slide", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while n := E.count():
        sized = apart if n > SMALL_LINKS else lambda d: d
        ends = E.unionByName(E.select("slide", F.col("b").alias("a"), F.col("a").alias("b")))
        P = cut_lineage(ends.groupBy("slide", "a").agg(F.min("b").alias("p")).select("slide", F.col("a").alias("v"), F.least("a", "p").alias("p")))
        up = P.select("slide", F.col("v").alias("p"), F.col("p").alias("q"))
        J = P
        for _ in range(2):
            J = J.join(sized(up), ["slide", "p"]).select("slide", "v", F.col("q").alias("p"))
        J = cut_lineage(J)
        old = labels
        if old is None:
            labels = cut_lineage(J.select("slide", "v", F.col("p").alias("root")))
        else:
            labels = cut_lineage(old.join(sized(J.select("slide", F.col("v").alias("root"), "p")), ["slide", "root"], "left").select(
                "slide", "v", F.coalesce("p", "root").alias("root")))
        a, b = (J.select("slide", F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        rest = cut_lineage(E.join(sized(a), ["slide", "a"]).join(sized(b), ["slide", "b"]).filter("pa <> pb").select(
            "slide", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop_stage(P, J, old, E)
        E = rest
    if labels is None:
        return E.select("slide", F.col("a").alias("v"), F.col("b").alias("root"))
    drop_stage(E)
    return labels


def label_components(M: DataFrame, tile: int = TILE) -> DataFrame:
    """4-connected components of the cells with ``m = 1``.

    ``label`` is the scan position of a component's first cell, so ids do not depend
    on partitioning.
    """
    key = F.col("y").cast("bigint") * ROW + F.col("x")
    tiles = cut_lineage(pack_tiles(M.filter("m = 1").select("slide", "x", "y", key.alias("key")), 0, tile))
    border = cut_lineage(_borders(tiles, tile))
    own = border.select("slide", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("key").alias("b"))
    met = _across(border, tile).join(apart(own), ["slide", "nx", "ny"]).select("slide", F.col("key").alias("a"), "b")
    roots = linked_roots(met)
    # A label says where it lies, so each tile gets the new names of its own labels only.
    at = lambda n: F.floor(n / tile).cast("int")
    names = roots.filter("v <> root").groupBy(
        "slide", at(F.col("v") % ROW).alias("tx"), at(F.floor(F.col("v") / ROW)).alias("ty")
    ).agg(F.collect_list(F.struct("v", "root")).alias("names"))

    def rename(r, pos, key):
        if r["names"] is None or not len(r["names"]):
            return pos, key
        old, new = (np.array([x[c] for x in r["names"]], np.int64) for c in ("v", "root"))
        order = np.argsort(old)
        at = np.minimum(np.searchsorted(old, key, sorter=order), len(old) - 1)
        hit = old[order][at] == key
        return pos, np.where(hit, new[order][at], key)

    cells = tiles.join(apart(names), TILE_KEY, "left").mapInPandas(_unpacked(rename, tile), BORDER)
    done = cut_lineage(cells.select("slide", "x", "y", F.col("key").alias("label")))
    drop_stage(tiles, border, roots)
    return done


def component_stats(L: DataFrame) -> DataFrame:
    return L.groupBy("slide", "label").agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"),
    )


def grow_keys(cells: DataFrame, step: int, tile: int = TILE) -> DataFrame:
    """Smallest key + ``step`` x moves that reaches each cell (``slide, x, y, key``; ``NONE`` where there is none yet).

    A round looks at borders only, finds the tiles that a neighbour's key would change, and
    settles those again from their own packed cells and all keys around them.
    """
    tiles = cut_lineage(pack_tiles(cells, step, tile))
    border = cut_lineage(_borders(tiles, tile))

    def settled(edge_only: bool):
        def make(r, pos, key):
            halo = r["halo"] if r["halo"] is not None else ()
            grid, open_, gy, gx = _grid(pos, key, tile, halo, r["tx"], r["ty"])
            key = _settle(grid, open_, step)[gy, gx]
            return _edge_of(pos, key, tile) if edge_only else (pos, key)
        return _unpacked(make, tile)

    def around(border):
        near = _across(border.filter(F.col("key") < NONE), tile)
        return near, near.groupBy(*TILE_KEY).agg(F.collect_list(F.struct("x", "y", "key")).alias("halo"))

    while True:
        near, halo = around(border)
        own = border.select("slide", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("key").alias("own"))
        active = cut_lineage(near.join(apart(own), ["slide", "nx", "ny"]).filter(F.col("own") - step > F.col("key")).select(*TILE_KEY).distinct())
        if active.isEmpty():
            break
        again = tiles.join(apart(halo.join(apart(active), TILE_KEY)), TILE_KEY).mapInPandas(settled(True), BORDER)
        new = cut_lineage(border.join(apart(active), TILE_KEY, "left_anti").unionByName(again))
        drop_stage(border, active)
        border = new
    done = cut_lineage(tiles.join(apart(halo), TILE_KEY, "left").mapInPandas(settled(False), BORDER).select("slide", "x", "y", "key"))
    drop_stage(tiles, border, active)
    return done


def hysteresis_grow(seeds: DataFrame, weak: DataFrame, tile: int = TILE) -> DataFrame:
    """Grow labelled seed cells into weak cells, ring by ring.

    A cell goes to the fragment that reaches it first, and among equals to the one
    with the smaller label; fragments meet but never merge.
    """
    s = seeds.select("slide", "x", "y", F.col("label").alias("key"))
    w = weak.filter("m = 1").select("slide", "x", "y").join(apart(s), ["slide", "x", "y"], "left_anti")
    grown = grow_keys(s.unionByName(w.withColumn("key", F.lit(int(NONE)))), DISTANCE, tile)
    return grown.filter(F.col("key") < NONE).select(
        "slide", "x", "y", F.col("key").bitwiseAND(F.lit(LABEL_MASK)).alias("label")
    )


def enclosed_gaps(M: DataFrame, tile: int = TILE) -> DataFrame:
    """Background components of a dense mask that do not touch its border."""
    gaps = label_components(M.select("slide", "x", "y", (1 - F.col("m")).alias("m")), tile)
    box = M.groupBy("slide").agg(
        F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")
    )
    s = component_stats(gaps).join(apart(box), "slide").filter(
        (F.col("minx") > F.col("bx0")) & (F.col("maxx") < F.col("bx1"))
        & (F.col("miny") > F.col("by0")) & (F.col("maxy") < F.col("by1"))
    )
    return gaps.join(apart(s.select("slide", "label", "cells")), ["slide", "label"])


def fill_holes(M: DataFrame, max_cells, tile: int = TILE) -> DataFrame:
    """Set enclosed background of at most ``max_cells`` cells (a number or a column)."""
    limit = max_cells if not isinstance(max_cells, (int, float)) else F.lit(max_cells)
    small = enclosed_gaps(M, tile).filter(F.col("cells") <= limit).select("slide", "x", "y", F.lit(1).alias("__f"))
    return M.join(apart(small), ["slide", "x", "y"], "left").withColumn("m", F.coalesce("__f", "m")).drop("__f")


def drop_artefacts(
    comp: DataFrame, slides: DataFrame, max_aspect: float = 10.0, min_width_um: float = 400.0,
    default_min_cells: int = 16,
) -> DataFrame:
    """Mark components as kept, too small, or artefact (long thin strips).

    ``comp`` has slide, cells and a box; ``slides`` has um_per_cell (null when the
    scale is unknown: then any strip goes) and optionally min_cells.
    """
    cols = ["slide", "um_per_cell"] + (["min_cells"] if "min_cells" in slides.columns else [])
    d = comp.join(slides.select(*cols), "slide", "left")
    w = F.greatest(F.lit(1), F.col("maxx") - F.col("minx") + 1)
    h = F.greatest(F.lit(1), F.col("maxy") - F.col("miny") + 1)
    thin, long = F.least(w, h), F.greatest(w, h)
    least = F.coalesce("min_cells", F.lit(default_min_cells)) if "min_cells" in slides.columns else F.lit(default_min_cells)
    strip = (long / thin >= max_aspect) & F.coalesce(thin * F.col("um_per_cell") < min_width_um, F.lit(True))
    return d.withColumn(
        "verdict", F.when(F.col("cells") < least, "small").when(strip, "artefact").otherwise("keep")
    )
