"""Half-precision maps on their bit patterns: counted and ranked without being widened or exploded.

Such a map has ``halves binary`` in place of ``values``: two bytes a gene, little-endian, as
containers store them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 16  # genes that are counted together: 2 x 65,536 counters each
HELD = 4 << 20  # values a task holds before it hands on their counts
SPREAD = 512  # partitions whose counts meet first, so a slide of any size is merged in many tasks
CODES = BLOCK << 17  # gene in block, pattern in order, side


def in_order(bits: np.ndarray) -> np.ndarray:
    """Half patterns as 16-bit keys that order and tie as their values do.

    Both zeros share a key; every NaN has the last one.
    """
    size = bits & np.uint16(0x7FFF)
    key = np.where(bits >> 15, np.uint16(0x8000) - size, np.uint16(0x8000) + size)
    return np.where(size > 0x7C00, np.uint16(0xFFFF), key).astype(np.uint16)


def key_values() -> np.ndarray:
    """The value of each key of :func:`in_order`."""
    key = np.arange(1 << 16, dtype=np.int64)
    bits = np.where(key >= 0x8000, key - 0x8000, 0x8000 | (0x8000 - key) & 0x7FFF)
    return bits.astype(np.uint16).view(np.float16).astype(np.float64)


def _kinds(E: DataFrame, but: str) -> tuple[list[str], str]:
    rest = [f for f in E.schema if f.name != but]
    return [f.name for f in rest], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)


def pack_halves(E: DataFrame) -> DataFrame:
    """``values`` rounded to half precision (to even; beyond 65,504 infinite), packed in a binary.

    A missing array stays missing, a missing value becomes NaN.
    """
    rest, kinds = _kinds(E, "values")

    def pack(batches):
        for b in batches:
            lists = b.column(len(rest))
            flat = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                raw = flat.astype("<f2").tobytes()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes) * 2])
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            packed = [raw[lo:hi] if ok else None for lo, hi, ok in zip(offsets, offsets[1:], there)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packed, pa.binary())], names=[*rest, "halves"])

    return E.select(*rest, "values").mapInArrow(pack, f"{kinds}halves binary")


def unpack_halves(E: DataFrame) -> DataFrame:
    """The map with ``values array<float>``, for operators that look at single genes."""
    rest, kinds = _kinds(E, "halves")

    def unpack(batches):
        for b in batches:
            values = [None if h is None else np.frombuffer(h, "<f2").astype(np.float32) for h in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(values, pa.list_(pa.float32()))], names=[*rest, "values"])

    return E.select(*rest, "halves").mapInArrow(unpack, f"{kinds}`values` array<float>")


def _pack_counts(code: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending codes and their counts, byte plane by byte plane of the steps between codes."""
    steps = np.diff(code, prepend=0).astype("<u4")
    planes = [steps.view(np.uint8).reshape(-1, 4).T.tobytes(), n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    return len(code).to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack_counts(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int.from_bytes(payload[:4], "little")
    planes = np.frombuffer(pa.decompress(payload[4:], 12 * k, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(planes[: 4 * k].reshape(4, k).T).view("<u4").ravel()
    n = np.ascontiguousarray(planes[4 * k :].reshape(8, k).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.int64)), n.astype(np.int64)


COUNTS = pa.schema([("slide", pa.string()), ("block", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
RANKED = pa.schema([("slide", pa.string()), ("gene_idx", pa.int32()), ("u", pa.float64()), ("n_in", pa.int64()), ("n_out", pa.int64()),
                    ("sum_in", pa.float64()), ("sum_out", pa.float64())])


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(COUNTS.names, values))], COUNTS)


def _counter(held_values: int, spread: int):
    """Counts of a task's patches, a row per slide and block of genes whenever ``held_values`` are held."""

    def counts(held, part):
        for (slide, genes), rows in held.items():
            keys, side = np.concatenate([k for k, _ in rows]), np.concatenate([s for _, s in rows])
            for block, g in enumerate(range(0, genes, BLOCK)):
                here = keys[:, g : g + BLOCK].astype(np.int64)
                code = (np.arange(here.shape[1]) << 17) + (here << 1) + side[:, None]
                yield _row(slide, block, part, _pack_counts(*np.unique(code, return_counts=True)))

    def count(batches):
        part = TaskContext.get().partitionId() // spread
        held: dict = {}
        size = 0
        for batch in batches:
            slides, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict = {}
            for i, raw in enumerate(batch.column(2).to_pylist()):
                if raw:
                    groups.setdefault((slides[i], len(raw) // 2), []).append((raw, bool(sides[i])))
            for group, rows in groups.items():
                keys = in_order(np.frombuffer(b"".join(r for r, _ in rows), "<u2")).reshape(-1, group[1])
                held.setdefault(group, []).append((keys, np.array([s for _, s in rows], np.int64)))
                size += keys.size
                if size >= held_values:
                    yield from counts(held, part)
                    held, size = {}, 0
        yield from counts(held, part)

    return count


def _merged(batches, close):
    """Counts under one key added up as they come; ``close(slide, block, part, table)`` at its end."""
    key, table = None, None
    for batch in batches:
        for *here, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key:
                if key is not None:
                    yield close(*key, table)
                key, table = here, np.zeros(CODES, np.int64)
            code, n = _unpack_counts(payload)
            table[code] += n
    if key is not None:
        yield close(*key, table)


def _handed(slide, block, part, table):
    code = np.flatnonzero(table)
    return _row(slide, block, 0, _pack_counts(code, table[code]))  # one part from here on


def _tested(slide, block, part, table):
    """Doubled pairs, counts and sums per gene from the whole table of a slide's block."""
    out, inside = table.reshape(BLOCK, 1 << 16, 2).transpose(2, 0, 1)
    below = np.cumsum(out, axis=1) - out
    u2 = (inside * (2 * below + out)).sum(axis=1)
    v = key_values()
    sums = [(n * np.where(n > 0, v, 0.0)).sum(axis=1) for n in (inside, out)]
    n_in, n_out = inside.sum(axis=1), out.sum(axis=1)
    there = np.flatnonzero(n_in + n_out)
    columns = [pa.array([slide] * len(there), pa.string()), pa.array((block * BLOCK + there).astype(np.int32)),
               *[pa.array(c[there]) for c in (u2 / 2, n_in, n_out, *sums)]]
    return pa.RecordBatch.from_arrays(columns, schema=RANKED)


def mann_whitney_halves(E: DataFrame, held: int = HELD, spread: int = SPREAD) -> DataFrame:
    """``slide, gene_idx, u, n_in, n_out, sum_in, sum_out`` of a map with ``halves`` and a boolean ``inside``.

    Equal to :func:`stats.mann_whitney` over the widened values, both zeros tied, NaN above
    all else.  Tasks hand on counts per pattern, packed per slide and block of BLOCK genes, so
    less is shuffled than is stored.  Counts of ``spread`` partitions meet first, then those of a
    slide; a task adds up one block at a time into 16 MB of counters, however many patches the
    slide has.  Patches without ``halves`` take no part, a missing ``inside`` is outside.
    """
    kinds = "slide string, block int, part bigint, counts binary"
    parts = E.where("halves IS NOT NULL").select("slide", "inside", "halves").mapInArrow(_counter(held, spread), kinds)
    first = ["slide", "block", "part"]
    near = parts.repartition(*first).sortWithinPartitions(*first).mapInArrow(lambda it: _merged(it, _handed), kinds)
    whole = near.repartition("slide", "block").sortWithinPartitions("slide", "block")
    return whole.mapInArrow(
        lambda it: _merged(it, _tested), "slide string, gene_idx int, u double, n_in bigint, n_out bigint, sum_in double, sum_out double")
