"""Byte-level BPE over annotation texts: chunked pre-tokenising, encoding, decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel, each
from its own start.  A match depends only on the text to its right, so as soon as two
runs share a boundary they agree from there on: the first boundary in the overlap that
both neighbours found is where their pieces meet.  The pieces are then encoded in
parallel and their ids put together again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, blank

LOOKAHEAD = 3  # characters behind a match that can still decide where it ends
CACHED = 150_000  # words whose ids a worker remembers, and as many from before
_tables: dict = {}


def read_ranks(path: str) -> bytes:
    """The rank file as it is: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


class _Words(dict):
    """Ids of the words a worker has met, as bytes.

    When full it starts anew and keeps what it had as a second chance, so words that come
    again and again stay while rare ones go.
    """

    def __init__(self, ranks: dict):
        super().__init__()
        self.ranks, self.before = ranks, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("I", merge_word(word.encode(), self.ranks)).tobytes()
        if len(word) < 40:
            if len(self) >= CACHED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _table(raw: bytes) -> tuple[dict, list, _Words]:
    """Ranks, tokens by id and the known words of this worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _tables:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        _tables[key] = (ranks, tokens, _Words(ranks))
    return _tables[key]


def merge_word(word: bytes, ranks: dict) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= 32:  # few pairs: looking at all of them again is quicker than a heap
        parts = [word[i:i + 1] for i in range(n)]
        get, none = ranks.get, len(ranks) + (1 << 40)
        pairs = [get(word[i:i + 2], none) for i in range(n - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        m = end[i]
        if m < 0 or m >= n or ranks.get(word[i:end[m]]) != r:
            continue  # one of the two was merged meanwhile
        end[i], end[m] = end[m], -1
        for a in (before[i], i):
            if a >= 0 and end[a] < n:
                before[end[a]] = a
                if (s := ranks.get(word[a:end[end[a]]])) is not None:
                    heapq.heappush(heap, (s, a))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


def _encode(texts: Iterable[str], raw: bytes, pattern: str, aheads: Iterable[str] | None = None) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    aheads    what follows each text: a match at its end may look at it
    """
    _, _, known = _table(raw)
    find = regex.compile(pattern)
    for text, ahead in zip(texts, aheads) if aheads is not None else ((t, "") for t in texts):
        words = [m.group() for m in find.finditer(text + ahead) if m.start() < len(text)] if ahead else find.findall(text)
        yield b"".join(map(known.__getitem__, words))


def _cutter(chunk: int, overlap: int, schema: pa.Schema):
    def cut(it):
        def rows():
            for b in it:
                for k, d, copies, text in zip(*(b.column(i) for i in range(4))):
                    t = text.as_py()
                    for no, at in enumerate(range(0, len(t), chunk)):
                        yield k.as_py(), d.as_py(), copies.as_py(), no, at, at + chunk + overlap >= len(t), t[at:at + chunk + overlap]
        yield from batches(schema, rows(), 500)
    return cut


def _seams(pattern: str, chunk: int, overlap: int, schema: pa.Schema):
    def find(it):
        run = regex.compile(pattern).finditer

        def rows():
            for b in it:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    at, last, t = r[4], r[5], r[6]
                    sure = len(t) if last else len(t) - LOOKAHEAD
                    head, tail = [at], []
                    for m in run(t):
                        e = m.end()
                        if e > sure:
                            break
                        if e < overlap:
                            head.append(at + e)
                        if e >= chunk:
                            tail.append(at + e)
                    yield (*r, head, tail)
        yield from batches(schema, rows(), 500)
    return find


def encode(annotations: DataFrame, ranks: bytes, pattern: str, id: str = "id", text: str = "name",
           chunk_chars: int = 32_768, overlap_chars: int = 1_024, decoded: bool = False) -> DataFrame:
    """Token ids of each annotation's text: ``id, ids binary, n_tokens``.

    annotations    one row per annotation: its id and free text (``name``)
    ranks          content of a rank file, see :func:`read_ranks`
    pattern        expression whose matches are encoded one by one
    ids            the ids, little-endian unsigned 32-bit
    decoded        also decode the ids where they are made: ``body``, as :func:`decode` gives

    A null or empty text has no ids.  Repeated rows and ids, also null ones, each keep
    their row; other columns are left out, whatever their names.  Texts over
    ``chunk_chars`` are cut into chunks that read ``overlap_chars`` on.  Where two
    chunks find no common boundary (a pre-token longer than the overlap) the rest of
    that text is one piece: slower, the same ids.  An empty table gives an empty table.
    """
    T = annotations.select(F.col(id).alias("k"), blank(text).alias("t"))
    spark_type = dict(T.dtypes)["k"]
    idf = pa.field("k", _arrow(T.schema["k"].dataType))
    one = pa.schema([idf, ("ids", pa.binary()), ("body", pa.binary())])
    made = f"k {spark_type}, ids binary, body binary"

    def whole(it):
        tokens = _table(ranks)[1]

        def rows():
            for b in it:
                for k, ids in zip(b.column(0).to_pylist(), _encode(b.column(1).to_pylist(), ranks, pattern)):
                    yield k, ids, _decode(ids, tokens) if decoded else None
        yield from batches(one, rows())

    plain = T.where(F.length("t") <= chunk_chars).mapInArrow(whole, made)

    cols = [idf, ("d", pa.binary()), ("copies", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("last", pa.bool_()), ("part", pa.string())]
    kind = f"k {spark_type}, d binary, copies bigint, no int, at bigint, last boolean, part string"
    long = (
        T.where(F.length("t") > chunk_chars).groupBy("k", "t").agg(F.count(F.lit(1)).alias("copies"))
        .select("k", F.unhex(F.sha2("t", 256)).alias("d"), "copies", "t")
        .mapInArrow(_cutter(chunk_chars, overlap_chars, pa.schema(cols)), kind)
        .repartition("d", "no")
    )
    found = long.mapInArrow(
        _seams(pattern, chunk_chars, overlap_chars, pa.schema([*cols, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])),
        kind + ", head array<bigint>, tail array<bigint>",
    )
    doc = W.partitionBy("k", "d").orderBy("no")
    upto = doc.rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = (
        found.withColumn("meet", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(doc), "head"))))
        .withColumn("sound", F.min(F.col("meet").isNotNull()).over(upto))
        .withColumn("start", F.when(F.col("sound"), F.col("meet")).otherwise(F.col("at")))
        .withColumn("piece", F.max(F.when(F.col("sound"), F.col("no"))).over(upto))
        .withColumn("stop", F.lead("start").over(doc))
        .withColumn("ahead", F.expr(f"coalesce(substring(part, CAST(stop - at + 1 AS INT), {LOOKAHEAD}), '')"))
        .withColumn("part", F.expr("substring(part, CAST(start - at + 1 AS INT), CAST(coalesce(stop, at + length(part)) - start AS INT))"))
        .groupBy("k", "d", "piece").agg(
            F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("no", "part"))).alias("p"), F.max_by("ahead", "no").alias("ahead"))
        .select("k", "d", "copies", "piece", F.array_join(F.col("p.part"), "").alias("t"), "ahead")
    )
    coded = pa.schema([idf, ("d", pa.binary()), ("copies", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])

    def part(it):
        def rows():
            for b in it:
                c = [x.to_pylist() for x in b.columns]
                yield from zip(*c[:4], _encode(c[4], ranks, pattern, c[5]))
        yield from batches(coded, rows(), 500)

    def joined(it):
        tokens = _table(ranks)[1]

        def rows():
            for b in it:
                for k, copies, p in zip(*(c.to_pylist() for c in b.columns)):
                    ids = b"".join(x["ids"] for x in p)
                    body = _decode(ids, tokens) if decoded else None
                    for _ in range(copies):
                        yield k, ids, body
        yield from batches(one, rows(), 500)

    stitched = (
        pieces.mapInArrow(part, f"k {spark_type}, d binary, copies bigint, piece int, ids binary")
        .groupBy("k", "d").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
        .select("k", "copies", "p").mapInArrow(joined, made)
    )
    out = plain.unionByName(stitched)
    return out.select(F.col("k").alias(id), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *(["body"] if decoded else []))


def _decode(ids: bytes | None, tokens: list[bytes]) -> bytes:
    """The tokens' bytes end to end."""
    return b"".join(map(tokens.__getitem__, array("I", ids or b"")))


def decode(encoded: DataFrame, ranks: bytes, id: str = "id") -> DataFrame:
    """Bytes behind the ids of :func:`encode`: ``id, ids, n_tokens, body binary``.

    The tokens' bytes are put end to end; a null list of ids gives no bytes.
    """
    T = encoded.select(F.col(id).alias("k"), "ids", "n_tokens")
    schema = pa.schema([("k", _arrow(T.schema["k"].dataType)), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("body", pa.binary())])

    def run(it):
        tokens = _table(ranks)[1]

        def rows():
            for b in it:
                for k, ids, n in zip(*(c.to_pylist() for c in b.columns)):
                    yield k, ids, n, _decode(ids, tokens)
        yield from batches(schema, rows())

    return T.mapInArrow(run, f"k {dict(T.dtypes)['k']}, ids binary, n_tokens bigint, body binary").withColumnRenamed("k", id)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
