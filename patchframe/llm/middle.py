"""Fill-in-middle: the middle of a text is moved behind its suffix, by rotations inside one buffer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank

# The strings that mark prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
_SCAN = 1 << 16


def _reverse(v: np.ndarray, a: int, b: int) -> None:
    """Reverse ``v[a:b]`` in place, swapping bounded pieces from both ends."""
    while b - a > 1:
        m = min((b - a) // 2, _SCAN)
        left = v[a:a + m].copy()
        v[a:a + m] = v[b - m:b][::-1]
        v[b - m:b] = left[::-1]
        a, b = a + m, b - m


def rotate(buf: bytearray, a: int, cut: int, b: int) -> None:
    """Exchange the neighbours ``buf[a:cut]`` and ``buf[cut:b]`` in place by three reversals."""
    v = np.frombuffer(buf, np.uint8)
    _reverse(v, a, cut)
    _reverse(v, cut, b)
    _reverse(v, a, b)


def byte_offset(text: bytes, chars: int) -> int:
    """Where the code point number ``chars`` starts; the length of ``text`` if it ends before."""
    for a in range(0, len(text), _SCAN):
        piece = np.frombuffer(text, np.uint8, min(_SCAN, len(text) - a), a)
        first = np.flatnonzero((piece & 0xC0) != 0x80)
        if chars < len(first):
            return a + int(first[chars])
        chars -= len(first)
    return len(text)


def to_form(text: bytes, form: str, c1: int, c2: int) -> bytes:
    """``text`` with prefix up to code point ``c1``, middle up to ``c2``, in the order of ``form``."""
    if form == "plain":
        return text
    if not text.isascii():
        c1, c2 = byte_offset(text, c1), byte_offset(text, c2)
    buf = bytearray(text)
    buf[c2:c2] = SUFFIX
    buf[c1:c1] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = c1 + len(PREFIX), c2 + len(PREFIX) + len(MIDDLE)
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return bytes(buf)


def from_form(output: bytes, form: str) -> bytes:
    """The text behind ``output``: the rotation is undone and the marks are taken out."""
    if form == "plain":
        return output
    buf = bytearray(output)
    if form == "psm":
        a, cut = buf.find(SUFFIX), buf.find(MIDDLE)
    else:
        a, cut = 0, buf.find(PREFIX)
    rotate(buf, a, cut, len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buf.find(mark)
        del buf[at:at + len(mark)]
    return bytes(buf)


def _mapped(column: str, kind: pa.DataType, make, out_bytes: int = 16 << 20):
    """Batches whose last column is ``make`` of their columns, cut where a batch gets large."""

    def run(it):
        for b in it:
            made, weight, first = [], 0, 0

            def out(upto):
                part = b.slice(first, upto - first)
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(made, kind)], [*b.schema.names, column])

            for i in range(len(b)):
                made.append(make(b, i))
                weight += len(made[-1])
                if weight >= out_bytes:
                    yield out(i + 1)
                    made, weight, first = [], 0, i + 1
            if made:
                yield out(len(b))
    return run


def move_middle(annotations: DataFrame, seed: int = 1, key: Sequence[str] = ("slide", "id"), text: str = "name",
                plain: int = 10, spm: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """Annotation texts in fill-in-middle form: ``*key, *keep, n, form, prefix_chars, middle_chars, output``.

    annotations   rows of ``slide, id, name``, or any ``key`` columns and ``text``
    n             code points of the text
    form          ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm``: ``<S>``
                  suffix ``<P>`` prefix ``<M>`` middle; ``plain``: the text as it is
    prefix_chars, middle_chars   code points of the two, null if plain

    The first four groups of eight digits of the hex SHA-256 of ``seed:key`` (key columns
    as text, joined by colons) decide: prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1), middle after the larger; ``plain`` percent by h3, ``spm`` percent of the
    rest by h4.  Texts that are empty or hold one of the marks are plain, so
    :func:`restore_middle` is exact for all.

    A null text is empty; a null key column counts as empty text in the digest and stays
    null.  Rows are handled one by one: repeated rows give equal rows, an empty table an
    empty result, and other columns do not matter.  A text is cut whole, however long; a
    task holds it about twice.
    """
    kept = [*key, *keep]
    own = [f"c{i}" for i in range(len(kept))]  # no name of the caller's meets one of ours
    T = annotations.select(*[F.col(c).alias(o) for c, o in zip(kept, own)], blank(text).alias("text"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in own[:len(key)]]), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for s in SENTINELS:
        marked = marked | F.contains("text", F.lit(s.decode()))
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    T = T.withColumn("digest", digest).withColumn("n", F.length("text").cast("long")).select(
        *own, "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "text")

    def make(b, i):
        f, a, c, t = (b.column(k)[i].as_py() for k in range(len(own) + 1, len(own) + 5))
        return to_form(t.encode(), f, a, c).decode()

    done = T.mapInArrow(_mapped("output", pa.string(), make), T.withColumn("output", F.lit("")).schema)
    moved = F.col("form") != "plain"
    return done.select(
        *[F.col(o).alias(c) for c, o in zip(kept, own)], "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"), "output",
    )


def restore_middle(moved: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``moved`` and its texts, ``restored`` from ``output`` and ``form`` alone.

    A null output or a null form gives null.  Other columns stay as they are.
    """
    T = moved.drop("restored")
    own = [f"c{i}" for i in range(len(T.columns))]
    text, kind = (own[T.columns.index(c)] for c in (output, form))
    gone = F.col(text).isNull() | F.col(kind).isNull()
    given = T.toDF(*own).withColumn("f", F.when(gone, "plain").otherwise(F.col(kind)))

    def make(b, i):
        t, f = (b.column(b.schema.get_field_index(c))[i].as_py() for c in (text, "f"))
        return from_form((t or "").encode(), f).decode()

    back = given.mapInArrow(_mapped("restored", pa.string(), make), given.withColumn("restored", F.lit("")).schema)
    return back.select(*[F.col(o).alias(c) for o, c in zip(own, T.columns)], F.when(~gone, F.col("restored")).alias("restored"))
