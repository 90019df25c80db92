"""Passages that annotation texts repeat from earlier ones, found with suffix arrays.

A string of ``length`` bytes is found through an anchor: the gram of 2 ^ m bytes within
it whose hash is least, the same wherever the string stands.  Anchors that no other text
has are dropped; equal surroundings of the others are folded, the smallest id deciding.
Where one gram stands in different surroundings, these become strings in which the gram
is one symbol, and a suffix array of them (:mod:`.suffixes`) brings equal strings
together.  Nothing depends on hashes alone but the anchor filter, which only lets
through too much, and the fold, which compares 96 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_stage, stage
from .suffixes import suffix_array
from .words import ODD, hashes, mix, text_chunks

ORDER_BITS, PLACE_BITS = np.uint64(33), np.uint64(31)
BLOCK = 6 << 20  # bytes of text that a task packs together
CROWD = 4096  # surroundings of one gram that are sorted together; more are compared string by string
SORTED = 12_000  # symbols that one suffix array is made of, if the next gram's strings do not fit


def gram_size(length: int) -> int:
    """Largest power of two within two thirds of the length: at least a third is left for an anchor to move."""
    return 1 << max(1, int(math.log2(max(length * 2 // 3, 2))))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of texts: text number, first and last window, anchor, gram hash.

    Windows are strings of ``length`` bytes within one text; windows in a row that
    share an anchor are one entry.
    """
    none = np.zeros(0, np.int64)
    gram = gram_size(length)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64)
    h, m = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while m < gram:
        h = h[:-m] * np.uint64(pow(ODD, m, 2**64)) + h[m:]
        m *= 2
    h = mix(h)
    low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    width, s = length - gram + 1, 1
    while s * 2 <= width:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if s < width:
        low = np.minimum(low[:len(low) - (width - s)], low[width - s:])
    a = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    p = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    a = a[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return owner[first], p[first], p[last], a[first], h[a[first]]


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 48-bit hashes; ascending with them."""
    return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(sorted_hashes: np.ndarray, buckets: int):
    """Buckets that occur, with the slice of each."""
    b = _bucket(sorted_hashes, buckets)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(b))):
        yield int(b[lo]), slice(lo, hi)


# Rows between tasks.  ids, pos, n: entries' text, place and number of windows; kind says what they are.
_PACK = pa.schema([("bucket", pa.int32()), ("blk", pa.binary()), ("kind", pa.int32()), ("own", pa.binary()), ("h", pa.binary()), ("x", pa.binary())])
PACK = "bucket int, blk binary, kind int, own binary, h binary, x binary"
KEYS, SHARED, ASK = 0, 1, 2
DUP, FINE, CROWDED = 1, 3, 4


def _shared_map(length: int, buckets: int):
    def run(it):
        def block(parts):
            ids = np.concatenate([p[0] for p in parts])
            base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
            own = np.concatenate([p[1] + b for p, b in zip(parts, base)])
            h = np.concatenate([p[2] for p in parts])
            o = np.argsort(h, kind="stable")
            h, own = h[o], own[o].astype(np.uint16)
            blk = hashlib.blake2b(ids.tobytes() + h.tobytes(), digest_size=16).digest()
            home = -1 - int.from_bytes(blk[:4], "little") % buckets
            yield home, blk, KEYS, None, None, ids.tobytes()
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            if not len(at):
                return
            many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            inside = many[np.cumsum(new) - 1]
            if inside.any():
                yield home, blk, SHARED, own[inside].tobytes(), _six(h[inside]), None
            h, own = h[at], np.where(many, np.uint16(0xFFFF), own[at])
            for b, s in _slices(h, buckets):
                yield b, blk, ASK, own[s].tobytes(), _six(h[s]), None

        def rows():
            held, size, texts = [], 0, 0
            for b in it:
                ids = np.asarray(b.column(0))
                for row, offsets, data in text_chunks(b.column(1), 1 << 18):
                    own, _, _, _, h = anchors(data, offsets, length)
                    held.append((ids[row:row + len(offsets) - 1], own, h >> np.uint64(16)))
                    size += len(data)
                    texts += len(offsets) - 1
                    if size >= BLOCK or texts >= 10_000:
                        yield from block(held)
                        held, size, texts = [], 0, 0
            if held:
                yield from block(held)
        yield from batches(_PACK, rows(), 512)
    return run


def _shared_find(key, t):
    """Grams of a bucket that stand in more than one text, back to their blocks."""
    if key[0].as_py() < 0:
        return t
    blk, own, h = t.column("blk").to_pylist(), t.column("own").to_pylist(), t.column("h").to_pylist()
    H = np.concatenate([_unsix(x) for x in h])
    O = np.concatenate([np.frombuffer(x, np.uint16) for x in own])
    which = np.repeat(np.arange(len(blk)), [len(x) // 2 for x in own])
    o = np.argsort(H, kind="stable")
    Hs = H[o]
    new = np.ones(len(Hs), bool)
    new[1:] = Hs[1:] != Hs[:-1]
    at = np.flatnonzero(new)
    more = np.diff(np.append(at, len(Hs))) > 1
    more |= np.maximum.reduceat(O[o], at) == 0xFFFF if len(at) else more
    yes = np.zeros(len(H), bool)
    yes[o] = more[np.cumsum(new) - 1]
    yes &= O != 0xFFFF
    cut = np.searchsorted(which, np.arange(len(blk) + 1))
    rows = []
    for i in range(len(blk)):
        s = slice(cut[i], cut[i + 1])
        if yes[s].any():
            rows.append((key[0].as_py(), blk[i], SHARED, O[s][yes[s]].tobytes(), _six(H[s][yes[s]]), None))
    return pa.Table.from_batches(list(batches(_PACK, rows, 1 << 20, 1 << 30)), _PACK)


def _shared_lists(key, t):
    """Per text of a block its shared grams."""
    schema = pa.schema([("id", pa.int64()), ("shared", pa.binary())])
    rows = t.to_pylist()
    ids = next((np.frombuffer(r["x"], np.int64) for r in rows if r["kind"] == KEYS), None)
    got = [r for r in rows if r["kind"] == SHARED]
    if ids is None or not got:
        return schema.empty_table()
    own = np.concatenate([np.frombuffer(r["own"], np.uint16) for r in got]).astype(np.int64)
    h = np.concatenate([_unsix(r["h"]) for r in got])
    o = np.lexsort((h, own))
    own, h = own[o], h[o]
    u, at = np.unique(own, return_index=True)
    return pa.table({"id": ids[u], "shared": [_six(x) for x in np.split(h, at[1:])]}, schema)


_PIECES = pa.schema([("id", pa.int64()), ("bytes", pa.binary()), ("at", pa.binary()), ("pos", pa.binary()), ("n", pa.binary()), ("da", pa.binary())])


def _pieces_map(length: int):
    """Per text the bytes around its shared anchors: where each entry's windows start in them (at) and in the text (pos), how many there are, and the anchor's distance."""
    def run(it):
        def rows():
            for b in it:
                ids, lists = b.column(0).to_pylist(), b.column(2).to_pylist()
                for row, offsets, data in text_chunks(b.column(1), 1 << 18):
                    own, p, q, a, h = anchors(data, offsets, length)
                    h = h >> np.uint64(16)
                    cut = np.searchsorted(own, np.arange(len(offsets)))
                    for i in range(len(offsets) - 1):
                        s = slice(cut[i], cut[i + 1])
                        keep = np.isin(h[s], _unsix(lists[row + i]))
                        if not keep.any():
                            continue
                        P, Q, A = p[s][keep], q[s][keep] + length, a[s][keep]
                        new = np.ones(len(P), bool)
                        new[1:] = P[1:] > Q[:-1]
                        first = np.flatnonzero(new)
                        lo, hi = P[first], Q[np.append(first[1:], len(P)) - 1]
                        body = b"".join([data[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())])
                        base = np.cumsum(np.append(0, (hi - lo)[:-1]))
                        run_ = np.cumsum(new) - 1
                        yield (ids[row + i], body, (P - lo[run_] + base[run_]).astype(np.int32).tobytes(), (P - offsets[i]).astype(np.int32).tobytes(),
                               (Q - length - P + 1).astype(np.uint8).tobytes(), (A - P).astype(np.uint8).tobytes())
        yield from batches(_PIECES, rows(), 2000, 8 << 20)
    return run


def _entries(row):
    return tuple(np.frombuffer(x, k).astype(np.int64) for x, k in zip(row[2:6], (np.int32, np.int32, np.uint8, np.uint8)))


_X = np.dtype([("id", "<i8"), ("c", "<u8"), ("pos", "<i4"), ("n", "u1")])


def _fold_map(length: int, buckets: int):
    """Entries by gram and surroundings; of equal ones in a block only those with the smallest id go on."""
    gram = gram_size(length)

    def run(it):
        def block(parts):
            g, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            o = np.lexsort((x["pos"], x["id"], x["c"], g))
            g, x = g[o], x[o]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (x["c"][1:] != x["c"][:-1])
            least = x["id"][new][np.cumsum(new) - 1]
            dup = x["id"] > least
            blk = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            if dup.any():
                yield -1 - int.from_bytes(blk[:4], "little") % buckets, blk, DUP, None, None, x[dup].tobytes()
            g, x = g[~dup], x[~dup]
            for b, s in _slices(g, buckets):
                yield b, blk, ASK, None, _six(g[s]), x[s].tobytes()

        def rows():
            held, size = [], 0
            for b in it:
                c = [v.to_pylist() for v in b.columns]
                body = b"".join(c[1])
                start = np.cumsum([0] + [len(v) for v in c[1]])
                at = [_entries(r) for r in zip(*c)]
                A = np.concatenate([e[0] + s for e, s in zip(at, start)])
                pos, n, da = (np.concatenate([e[k] for e in at]) for k in (1, 2, 3))
                data = np.frombuffer(body, np.uint8)
                x = np.empty(len(A), _X)
                x["id"] = np.repeat(np.array(c[0], np.int64), [len(e[0]) for e in at])
                x["c"] = hashes(data, A, A + n - 1 + length) ^ mix(da.astype(np.uint64))
                x["pos"], x["n"] = pos, n
                held.append((hashes(data, A + da, A + da + gram) >> np.uint64(16), x))
                size += len(body)
                if size >= BLOCK // 2:
                    yield from block(held)
                    held, size = [], 0
            if held:
                yield from block(held)
        yield from batches(_PACK, rows(), 256)
    return run


def _fold_find(crowd: int):
    """Equal surroundings: all but the smallest id's are repeats.  A gram in several surroundings goes on to sorting."""
    return lambda key, t: t if key[0].as_py() < 0 else _fold_bucket(key[0].as_py(), t, crowd)


def _fold_bucket(bucket: int, t: pa.Table, crowd: int) -> pa.Table:
    blk, h, xs = t.column("blk").to_pylist(), t.column("h").to_pylist(), t.column("x").to_pylist()
    g, x = np.concatenate([_unsix(v) for v in h]), np.concatenate([np.frombuffer(v, _X) for v in xs])
    which = np.repeat(np.arange(len(blk)), [len(v) // 6 for v in h])
    o = np.lexsort((x["id"], x["c"], g))
    g, x, which = g[o], x[o], which[o]
    newg = np.ones(len(g), bool)
    newg[1:] = g[1:] != g[:-1]
    new = newg.copy()
    new[1:] |= x["c"][1:] != x["c"][:-1]
    least = x["id"][new][np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(newg))[np.cumsum(newg) - 1]
    kind = np.where(x["id"] > least, DUP, np.where(kinds > crowd, CROWDED, np.where(kinds > 1, FINE, 0)))
    rows = []
    o = np.lexsort((kind, which))
    x, kind, which = x[o], kind[o], which[o]
    cut = np.flatnonzero(np.diff(which * 8 + kind, prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(x))):
        if kind[lo]:
            rows.append((bucket, blk[which[lo]], int(kind[lo]), None, None, x[lo:hi].tobytes()))
    return pa.Table.from_batches(list(batches(_PACK, rows, 1 << 20, 1 << 30)), _PACK)


_D = np.dtype([("pos", "<i4"), ("n", "u1")])


def _fold_lists(key, t):
    """Per text of a block: repeats found, and places that go on to sorting."""
    schema = pa.schema([("id", pa.int64()), ("dup", pa.binary()), ("fine", pa.binary())])
    rows = t.to_pylist()
    x = np.concatenate([np.frombuffer(r["x"], _X) for r in rows]) if rows else np.zeros(0, _X)
    kind = np.repeat([r["kind"] for r in rows], [len(r["x"]) // _X.itemsize for r in rows])
    o = np.argsort(x["id"], kind="stable")
    x, kind = x[o], kind[o]
    u, at = np.unique(x["id"], return_index=True)
    dup, fine = [], []
    for lo, hi in zip(at, np.append(at[1:], len(x))):
        d, k = x[lo:hi], kind[lo:hi]
        out = np.empty(int((k == DUP).sum()), _D)
        out["pos"], out["n"] = d["pos"][k == DUP], d["n"][k == DUP]
        dup.append(out.tobytes() if len(out) else None)
        f = np.empty(int((k >= FINE).sum()), _D)
        f["pos"], f["n"] = d["pos"][k >= FINE], k[k >= FINE]
        fine.append(f.tobytes() if len(f) else None)
    return pa.table({"id": u, "dup": dup, "fine": fine}, schema)


_S = np.dtype([("id", "<i8"), ("pos", "<i4"), ("n", "u1"), ("da", "u1"), ("one", "u1")])


def _strings_map(length: int, buckets: int):
    """The surroundings to sort, by gram; of a crowded gram, single strings by content, the smallest id of each block."""
    gram = gram_size(length)

    def run(it):
        def block(parts):
            x = np.concatenate([p[0] for p in parts])
            body = [s for p in parts for s in p[1]]
            h = np.array([int.from_bytes(hashlib.blake2b(s if one else s[d:d + gram], digest_size=6).digest(), "little") for s, d, one in zip(body, x["da"].tolist(), x["one"].tolist())], np.uint64)
            best: dict = {}
            drop = np.zeros(len(x), bool)
            for i in np.flatnonzero(x["one"]):
                j = best.get(body[i])
                if j is None or x["id"][i] < x["id"][j]:
                    best[body[i]] = i
            for i in np.flatnonzero(x["one"]):
                drop[i] = x["id"][i] > x["id"][best[body[i]]]
            blk = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            if drop.any():
                yield -1 - int.from_bytes(blk[:4], "little") % buckets, blk, DUP, None, None, x[drop].tobytes()
            o = np.flatnonzero(~drop)
            o = o[np.argsort(h[o], kind="stable")]
            for b, s in _slices(h[o], buckets):
                yield b, blk, ASK, None, b"".join([body[i] for i in o[s]]), x[o[s]].tobytes()

        def rows():
            held, size = [], 0
            for b in it:
                for r in zip(*(v.to_pylist() for v in b.columns)):
                    at, pos, n, da = _entries(r)
                    f = np.frombuffer(r[6], _D)
                    o = np.searchsorted(pos, f["pos"])  # pos ascends
                    x, body = [], []
                    for k, crowded in zip(o.tolist(), (f["n"] == CROWDED).tolist()):
                        A, N, D, P = int(at[k]), int(n[k]), int(da[k]), int(pos[k])
                        for w in range(N) if crowded else (0,):
                            m = 1 if crowded else N
                            x.append((r[0], P + w, m, D - w, crowded))
                            body.append(r[1][A + w:A + w + m - 1 + length])
                    held.append((np.array(x, _S), body))
                    size += sum(map(len, body))
                    if size >= BLOCK // 4:
                        yield from block(held)
                        held, size = [], 0
            if held:
                yield from block(held)
        yield from batches(_PACK, rows(), 256)
    return run


def _strings_find(length: int):
    gram = gram_size(length)
    reach = length - gram + 1  # symbols of a string

    def sort(strings, x, group):
        """Windows among these surroundings that an earlier text has too: entry and offset."""
        text, starts, entry, off = [], [], [], []
        for i, s in enumerate(strings):
            d = int(x["da"][i])
            n = int(x["n"][i])
            starts += range(len(text), len(text) + n)
            entry += [i] * n
            off += range(n)
            text += [v + 1 for v in s[:d]]
            text.append(257 + int(group[i]))
            text += [v + 1 for v in s[d + gram:]]
            text.append(0)
        T = np.array(text)
        name = np.full(len(T), -1)
        name[starts] = np.arange(len(starts))
        order = suffix_array(T)
        order = order[name[order] >= 0]
        # Neighbours in suffix order that agree over a whole string are the same string.
        view = np.lib.stride_tricks.sliding_window_view(np.append(T, np.zeros(reach, T.dtype)), reach)
        new = np.ones(len(order), bool)
        for a in range(1, len(order), 1 << 15):
            b = min(len(order), a + (1 << 15))
            new[a:b] = (view[order[a:b]] != view[order[a - 1:b - 1]]).any(axis=1)
        entry, off = np.array(entry)[name[order]], np.array(off)[name[order]]
        ids = x["id"][entry]
        least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
        later = ids > least
        return entry[later], off[later]

    def find(key, t):
        schema = pa.schema([("id", pa.int64()), ("dup", pa.binary())])
        xs = [np.frombuffer(v, _S) for v in t.column("x").to_pylist()]
        x = np.concatenate(xs)
        if key[0].as_py() < 0:
            ids, pos, n = x["id"], x["pos"], x["n"]
        else:
            strings: list = []
            for body, own in zip(t.column("h").to_pylist(), xs):
                end = np.cumsum(own["n"].astype(np.int64) - 1 + length).tolist()
                strings += [body[a:b] for a, b in zip([0, *end[:-1]], end)]
            grams = [s if one else s[d:d + gram] for s, d, one in zip(strings, x["da"].tolist(), x["one"].tolist())]
            order = sorted(range(len(x)), key=grams.__getitem__)
            ids, pos = [], []
            held, group, size, last = [], [], 0, None

            def flush():
                e, w = sort([strings[i] for i in held], x[held], group)
                ids.append(x["id"][held][e])
                pos.append(x["pos"][held][e] + w)

            for i in order:
                if grams[i] != last:
                    if size >= SORTED:
                        flush()
                        held, group, size = [], [], 0
                    last = grams[i]
                    mark = group[-1] + 1 if group else 0
                held.append(i)
                group.append(mark)
                size += len(strings[i]) - gram + 2
            if held:
                flush()
            ids, pos = np.concatenate(ids), np.concatenate(pos)
            n = np.ones(len(ids), np.int64)
        o = np.lexsort((pos, ids))
        ids, pos, n = ids[o], pos[o], n[o]
        u, at = np.unique(ids, return_index=True)
        out = []
        for lo, hi in zip(at, np.append(at[1:], len(ids))):
            d = np.empty(hi - lo, _D)
            d["pos"], d["n"] = pos[lo:hi], n[lo:hi]
            out.append(d.tobytes())
        return pa.table({"id": u, "dup": out}, schema)

    return find


def remove_repeats(annotations: DataFrame, length: int = 50, id: str = "id", text: str = "name", crowd: int = CROWD,
                   whole_characters: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Annotations without what earlier ones say too: ``id, keep…, n_bytes, spans, n_removed, kept``.

    annotations   id (integer) and free text (``name``), as UTF-8 bytes
    spans         removed runs of bytes, ``start, stop``, maximal and in order
    kept          the other bytes, end to end
    keep          columns carried along
    whole_characters   leave a character that is covered in part, so that ``kept`` is text

    A byte goes if a string of ``length`` bytes that covers it also starts in an
    annotation with a smaller id.  Strings do not cross texts, may overlap, and are
    looked for in the texts as they came in, so order of work does not matter.

    Only hashes, folded entries and the surroundings of grams in mixed company travel,
    packed by bucket; the number of buckets follows the amount of text.  A gram or
    passage that very many texts share is folded per block first, and a gram in more
    than ``crowd`` surroundings is compared string by string under their own keys, so no
    task receives all of a passage's copies.  Texts are shuffled by id twice.

    A null text is empty; a null id is in no order, so its row is kept whole and removes
    nothing.  Repeated rows remove nothing from each other; an id should stand for one
    text (a repeat found at a place of one is cut there from all).  An empty table gives
    an empty result; other columns do not matter.
    """
    if length < 4:
        raise ValueError("repeats: a length of at least 4 bytes is needed")
    if length - gram_size(length) + 1 > 255:  # windows an anchor can have; entries hold their number in a byte
        raise ValueError(f"repeats: strings of {length} bytes have more windows to an anchor than entries can hold; up to 382 and 384 to 510 work")
    keep = keep or []
    A = annotations.select(
        F.col(id).cast("long").alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    carried = [f"k{i}" for i in range(len(keep))]
    known = A.where("id IS NOT NULL").select("id", "t")
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(16, math.ceil(total / (4 << 20)))

    asked = known.mapInArrow(_shared_map(length, buckets), PACK)
    shared = asked.groupBy("bucket").applyInArrow(_shared_find, PACK)
    parts = stage(shared.groupBy("blk").applyInArrow(_shared_lists, "id bigint, shared binary"), "shared")
    lists = stage(parts.groupBy("id").agg(F.collect_list("shared").alias("s")).select("id", F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0], lambda a, x: F.concat(a, x)).alias("shared")), "shared")
    drop_stage(parts)
    pieces = known.join(lists, "id").select("id", "t", "shared")
    kind = "id bigint, bytes binary, at binary, pos binary, n binary, da binary"
    pieces = stage(pieces.mapInArrow(_pieces_map(length), kind), "pieces")

    drop_stage(lists)
    few = max(16, math.ceil(buckets / 2))
    folded = pieces.mapInArrow(_fold_map(length, few), PACK).groupBy("bucket").applyInArrow(_fold_find(crowd), PACK)
    folded = folded.groupBy("blk").applyInArrow(_fold_lists, "id bigint, dup binary, fine binary")
    folded = stage(folded, "folded")
    fine = folded.where("fine IS NOT NULL").groupBy("id").agg(F.collect_list("fine").alias("f")).select(
        "id", F.aggregate(F.slice("f", 2, F.size("f")), F.col("f")[0], lambda a, x: F.concat(a, x)).alias("fine"))
    strings = pieces.join(fine, "id").select("id", "bytes", "at", "pos", "n", "da", "fine").mapInArrow(_strings_map(length, few), PACK)
    sorted_ = stage(strings.groupBy("bucket").applyInArrow(_strings_find(length), "id bigint, dup binary"), "sorted")
    drop_stage(pieces)
    dups = folded.where("dup IS NOT NULL").select("id", "dup").unionByName(sorted_).groupBy("id").agg(F.collect_list("dup").alias("dup"))

    def cut(it):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in it:
            sizes, spans, kept = [], [], []
            for t, dup in zip(b.column("t").to_pylist(), b.column("dup").to_pylist()):
                runs = _runs(dup, len(t), length)
                if whole_characters:
                    runs = [(x, y) for x, y in ((_inward(t, x, 1), _inward(t, y, -1)) for x, y in runs) if x < y]
                sizes.append(len(t))
                spans.append([{"start": x, "stop": y} for x, y in runs])
                kept.append(b"".join([t[x:y] for x, y in zip([0, *[y for _, y in runs]], [*[x for x, _ in runs], len(t)])]))
            own = [b.column(c) for c in ("id", *carried)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", *carried, "n_bytes", "spans", "kept"])

    J = A.join(dups, "id", "left").select("id", *carried, "t", "dup")
    kind = "".join(f"{c} {t}, " for c, t in J.select("id", *carried).dtypes)
    out = J.mapInArrow(cut, kind + "n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.select(
        F.col("id").alias(id), *[F.col(k).alias(c) for k, c in zip(carried, keep)], "n_bytes", "spans",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"), "kept")


def _runs(dup: list | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of a text from the places of its repeated strings."""
    if not dup:
        return []
    d = np.concatenate([np.frombuffer(v, _D) for v in dup])
    d = d[d["pos"] < size]
    lo = d["pos"].astype(np.int64)
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(np.minimum(lo + d["n"] - 1 + length, size)[o])
    if not len(lo):
        return []
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(hi)) - 1].tolist()))


def _inward(t: bytes, at: int, step: int) -> int:
    """Nearest place from ``at`` on where a character begins."""
    while 0 < at < len(t) and t[at] & 0xC0 == 0x80:
        at += step
    return at
