"""Fill-in-middle against plain string slices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from patchframe.llm import middle

NOTES = "slide string, id string, name string, n string, form int, output string, _text long"


def notes(spark, rows):
    """Annotations with columns whose names the operator uses inside."""
    return spark.createDataFrame([(s, i, t, "n", 1, "o", 5) for s, i, t in rows], NOTES)


def plain_middle(key, t, seed, plain, spm):
    x = hashlib.sha256(":".join([str(seed), *[k or "" for k in key]]).encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_texts_are_moved_and_restored(spark):
    rng = random.Random(4)
    parts = ["a", "é", "日", "🙂", "<P", ">", "<", "S>", "M", "\n", "\x00", "<<", "P>", " tissue "]
    rows = [(f"s{k % 3}", f"a-{k}", "".join(rng.choices(parts, k=rng.randint(0, 60)))) for k in range(400)]
    rows += [("s1", "null", None), ("s1", "empty", ""), ("s1", "mark", "x<S>y"), (None, "no slide", "abc"), ("s1", None, "abcd"), rows[5], rows[5]]
    rows += [("s1", f"long-{k}", "aé" * 150_000 + "z" * k) for k in range(4)]
    got = middle.restore_middle(middle.move_middle(notes(spark, rows), seed=7, plain=15, spm=40)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"slide", "id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    texts = {(s, i): t or "" for s, i, t in rows}
    for r in got:
        t = texts[r.slide, r.id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle((r.slide, r.id), t, 7, 15, 40)
        assert r.restored == t
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sum(r.id == rows[5][1] for r in got) == 3


def test_nothing_and_columns_kept(spark):
    assert middle.restore_middle(middle.move_middle(notes(spark, []))).count() == 0
    one = middle.move_middle(notes(spark, [("s", "1", "text")]), keep=["_text"])
    assert one.columns == ["slide", "id", "_text", "n", "form", "prefix_chars", "middle_chars", "output"] and one.first()._text == 5


def test_null_outputs_give_null(spark):
    moved = spark.createDataFrame([(None, "psm", 1), ("x", None, 2), ("x", "plain", 3)], "output string, form string, restored int")
    assert [r.restored for r in middle.restore_middle(moved).orderBy(F.col("form").desc_nulls_first()).collect()] == [None, None, "x"]


@pytest.mark.parametrize("a,cut,b", [(0, 0, 9), (0, 4, 9), (2, 9, 9), (3, 5, 8), (1, 2, 9)])
def test_three_reversals_exchange_neighbours(monkeypatch, a, cut, b):
    for piece in (1, 2, 1 << 16):
        monkeypatch.setattr(middle, "_SCAN", piece)
        buf = bytearray(b"012345678")
        middle.rotate(buf, a, cut, b)
        assert buf == b"012345678"[:a] + b"012345678"[cut:b] + b"012345678"[a:cut] + b"012345678"[b:]
        assert [middle.byte_offset("aé日🙂".encode(), k) for k in range(6)] == [0, 1, 3, 6, 10, 10]
