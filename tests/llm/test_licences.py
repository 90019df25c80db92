"""License scans against plain loops and regular expressions."""

import random
import re

import pytest

from patchframe.llm import licences

NOTES = "slide string, id string, name string, labels int, score string, _text long"
PHRASES = {"a b": "one", "b b": "two", "c": "three"}
TEMPLATES = [
    ("two", 'a <<beginOptional>>b c<<endOptional>> d <<var;original="x > y";words=0..2>> e'),
    ("four", 'c <<var;original="";words=1..3>> <<beginOptional>>d<<endOptional>> <<beginOptional>>e<<endOptional>> a'),
    ("five", 'b b <<var;words=2..2>> b'),
]


def notes(spark, rows):
    return spark.createDataFrame([(s, i, t, 1, "s", 5) for s, i, t in rows], NOTES)


def pattern(template):
    out = " "
    for kind, what in licences.regions(template):
        out += "(?:[^ ]+ ){%d,%d}" % what if kind == "any" else " ".join(what) + " " if kind == "words" else "(?:%s )?" % " ".join(what)
    return out


def plain_scan(text, phrases, templates, full):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, base, labels, most = [], set(), set(), 0
    for p, label in phrases.items():
        p = p.split()
        here = [k for k in range(len(w)) if w[k:k + len(p)] == p]
        at += here
        if here:
            base.add(label)
            most = max(most, len(p))
    for label, t in templates:
        if re.search(pattern(t), " " + " ".join(w) + " "):
            labels.add(label)
            most = max(most, sum(len(x) for k, x in licences.regions(t) if k == "words"))
    return (len(w), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | labels), min(1.0, most / full))


def test_scan_against_plain_loops(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e", "A", "B", "f", "é", "ß", "7", "É"]
    gaps = [" ", " ", "-", "\n", "; ", "\x00", "\x7f", "{", "@"]
    rows = [("s1", str(k), "".join(x for _ in range(rng.randint(0, 25)) for x in (rng.choice(words), rng.choice(gaps)))) for k in range(600)]
    rows += [("s1", "null", None), ("s1", "empty", ""), ("s1", "marks", "--- ;"), (None, "x", "a b"), ("s1", None, "c"), rows[0], ("s2", "long", "f " * 100_000 + "a b c d e " * 3000)]
    rows += [("s2", "one long word", "a" * 300_000 + " b b")]
    got = licences.scan_licences(notes(spark, rows), PHRASES, TEMPLATES, full=5).collect()
    assert len(got) == len(rows)
    by = {(r.slide, r.id): r for r in got}
    for s, i, t in rows:
        r = by[s, i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score)) == plain_scan(t, PHRASES, TEMPLATES, 5), t
        assert {p.label for p in r.places} <= set(r.labels) and all(0 <= p.start < p.end <= r.n_words for p in r.places)
    assert {x for r in got for x in r.labels} == {"one", "two", "three", "four", "five"}
    assert licences.scan_licences(notes(spark, [])).count() == 0


def test_places_are_where_the_wording_stands(spark):
    r = licences.scan_licences(notes(spark, [("s", "1", "x a d e a b c d f f e c")]), PHRASES, TEMPLATES).first()
    assert [(p.label, p.start, p.end) for p in r.places] == [("two", 1, 4), ("two", 4, 11)]


def filled(template, optional, words):
    return "".join(" ".join(what) + " " if kind == "words" else (" ".join(what) + " " if optional else "") if kind == "optional"
                   else "some " * (what[0] if words == "least" else what[1]) for kind, what in licences.regions(template))


def test_shipped_templates_take_their_own_texts_and_no_others(spark):
    rows, wrong = [], []
    for k, (label, t) in enumerate(licences.TEMPLATES):
        for j, (optional, size) in enumerate([(0, "least"), (1, "least"), (0, "most"), (1, "most")]):
            rows.append((label, f"{k}-{j}", "Notes. " + filled(t, optional, size).upper() + "more"))
        w = filled(t, 0, "least").split()
        wrong.append((label, f"{k}-cut", " ".join(w[:-1])))
        wrong.append((label, f"{k}-other", " ".join([*w[:1], "strange", *w[1:]])))
    found = {r.id: r for r in licences.scan_licences(notes(spark, rows + wrong), phrases={}).collect()}
    for label, i, _ in rows:
        assert label in found[i].labels
    for k, (label, t) in enumerate(licences.TEMPLATES):
        own = re.compile(pattern(t))
        for _, i, text in wrong:
            assert any(p.label == label for p in found[i].places) == any(
                re.search(pattern(x), f" {text} ") is not None for y, x in licences.TEMPLATES if y == label), (label, i)
        assert own.search(" " + " ".join(licences.words(rows[4 * k][2])) + " ")


def test_malformed_templates_are_refused():
    for t in ("<<beginOptional>>a<<endOptional>> b", "a <<beginOptional>>b", "a <<var;words=0..3>>", "a <<endOptional>> b", "", "a <<beginOptional>>b <<var;words=1..2>><<endOptional>> c"):
        with pytest.raises(ValueError):
            licences.regions(t)
