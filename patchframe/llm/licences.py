"""License scans by template markup: optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank

# Phrases with the label they stand for, then templates of notices and license texts.
# Markup: <<beginOptional>> ... <<endOptional>> may be missing; <<var;original="...";words=a..b>> stands
# for any a to b words; all other words must be there exactly, in this order.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", 'under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>Expat<<endOptional>> MIT <<beginOptional>>open source<<endOptional>> license'),
    ("mit", 'SPDX-License-Identifier: MIT'),
    ("mit", '''Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;original="this software and
        associated documentation files (the "Software")";words=1..20>>, to deal in the Software without restriction, including without
        limitation <<beginOptional>>on<<endOptional>> the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of <<var;original="the Software";words=1..6>>. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;original="THE AUTHORS OR COPYRIGHT HOLDERS";words=1..20>> BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE'''),
    ("isc", '''Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND <<var;original="THE AUTHOR";words=1..12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'''),
    ("bsd-2-clause", '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<var;original="1.";words=0..1>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<var;original="2.";words=0..1>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;original="THE COPYRIGHT HOLDERS";words=1..12>> AS IS'''),
    ("bsd-3-clause", '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<var;original="1.";words=0..1>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<var;original="2.";words=0..1>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. <<var;original="3.";words=0..1>> Neither the name of
        <<var;original="the copyright holder";words=1..20>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission'''),
    ("apache-2", '''Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use
        <<var;original="this file";words=1..4>> except in compliance with the License'''),
    ("apache-2", 'SPDX-License-Identifier: Apache-2.0'),
    ("gpl-3", '''licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>(GPL)<<endOptional>>
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3'''),
    ("gpl-3", '''This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License'''),
    ("cc-by-nc", '''licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution NonCommercial <<var;original="4.0";words=0..3>>
        <<beginOptional>>International<<endOptional>> License'''),
    ("cc-by-nc", 'creativecommons.org/licenses/by-nc'),
    ("all-rights-reserved", 'all rights reserved'),
]

RESULT = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, "
          "places array<struct<label:string,start:bigint,end:bigint>>, score double")

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r'<<(beginOptional|endOptional|var;(?:[^>]|>(?!>))*?words=(\d+)\.\.(\d+))>>')
ANY = -1


def words(text: str) -> list[str]:
    """Words of a text: digits, small letters (A-Z are lowered) and all characters beyond ASCII."""
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


def regions(template: str) -> list[tuple[str, object]]:
    """A template's regions in order: ``("words", [...])``, ``("optional", [...])``, ``("any", (least, most))``."""
    out: list = []
    kind, at = "words", 0
    for m in [*_MARK.finditer(template), None]:
        inner = words(template[at:m.start() if m else len(template)])
        if inner:
            out.append((kind, inner))
        if m is None:
            break
        at = m.end()
        if m[1] in ("beginOptional", "endOptional"):
            if (m[1] == "beginOptional") != (kind == "words"):
                raise ValueError(f"licences: optional regions must not nest: {template[:40]}")
            kind = "optional" if kind == "words" else "words"
        elif kind == "optional":
            raise ValueError(f"licences: a replaceable region within an optional one: {template[:40]}")
        else:
            out.append(("any", (int(m[2]), int(m[3]))))
    if kind == "optional":
        raise ValueError(f"licences: an optional region does not end: {template[:40]}")
    if not out or out[0][0] != "words" or out[-1][0] != "words":
        raise ValueError(f"licences: a template starts and ends with mandatory words: {template[:40]}")
    return out


class Automaton:
    """A template over word numbers.  State k has read up to step k; a step takes its word, or any word."""

    def __init__(self, template: str, number: dict[str, int]):
        self.steps: list[int] = []
        skips: list[tuple[int, int]] = []
        self.mandatory = 0
        for kind, what in regions(template):
            first = len(self.steps)
            if kind == "any":
                least, most = what
                self.steps += [ANY] * most
                skips += [(first + k, first + k + 1) for k in range(least, most)]
            else:
                self.steps += [number.setdefault(w, len(number) + 1) for w in what]
                if kind == "optional":
                    skips.append((first, len(self.steps)))
                else:
                    self.mandatory += len(what)
        self.lead = next(len(what) for _, what in regions(template))
        n = len(self.steps)
        reach: list[set] = [{k} for k in range(n + 1)]
        for a, b in sorted(skips, reverse=True):
            reach[a] |= reach[b]
        self.reach = [tuple(sorted(r)) for r in reach]

    def run(self, ids, starts) -> list[tuple[int, int]]:
        """Places ``(first word, end)`` where the template stands in one text; of several with one end, the first."""
        end, found, active, k, at = len(self.steps), [], {}, 0, 0
        while active or k < len(starts):
            if not active:
                at = starts[k]
            if k < len(starts) and starts[k] == at:
                for s in self.reach[0]:
                    active.setdefault(s, at)
                k += 1
            if at == len(ids):
                break
            w, after = ids[at], {}
            at += 1
            for s, first in active.items():
                if self.steps[s] == w or self.steps[s] == ANY:
                    for r in self.reach[s + 1]:
                        if after.get(r, at) > first:
                            after[r] = first
            if end in after:
                found.append((after.pop(end), at))
            active = after
        return found


def _stand(flat: np.ndarray, phrase: Sequence[int]) -> np.ndarray:
    """Where the words of ``phrase`` stand consecutively."""
    n = len(flat) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(flat[:n] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = at[flat[at + k] == w]
    return at


def scan_licences(annotations: DataFrame, phrases: dict[str, str] | None = None, templates: Sequence[tuple[str, str]] | None = None,
                  key: Sequence[str] = ("slide", "id"), text: str = "name", full: int = 20) -> DataFrame:
    """License wording in annotation texts: ``*key, n_words, n_base, first_word, last_word, base_labels, labels, places, score``.

    annotations   rows of ``slide, id, name``, or any ``key`` columns and ``text``
    phrases       wording -> label; templates: (label, template with markup)

    A-Z are lowered; words are runs of digits, letters a-z and characters beyond ASCII.

    n_base        places where the words of a phrase stand consecutively, overlaps included
    first_word, last_word   smallest and largest start of such a place (words from 0), else null
    base_labels   labels of the phrases found, distinct and sorted
    labels        these and the labels of the templates accepted
    places        ``label, start, end`` (words) of every template accepted, by start
    score         evidence, 0 to 1: the most mandatory words of one wording found, by ``full``
                  (a notice of ``full`` or more exact words counts 1)

    A template is compiled into an automaton whose optional regions can be skipped and whose
    replaceable regions take any words within their bounds; a place is accepted only if all
    mandatory words are there, exactly and in order.  All starts of a text run at once, so a
    text costs its words times the states alive.  Templates start and end with mandatory words.

    A null text is empty: no words, no labels, score 0.  Rows are handled one by one, so
    repeated rows give equal rows and an empty table an empty result; null keys stay.
    Other columns do not matter.  Texts are read whole, four bytes a word.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    number: dict[str, int] = {}
    base = [([number.setdefault(w, len(number) + 1) for w in words(p)], label) for p, label in phrases.items()]
    if not all(p for p, _ in base):
        raise ValueError("licences: a phrase without words")
    machines = [(Automaton(t, number), label) for label, t in templates]
    known = {w.encode(): n for w, n in number.items()}
    get = known.get

    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("places", pa.list_(place)), ("score", pa.float64())]

    def scan(column):
        """Result rows of the texts of one batch."""
        ids, sizes = [], []
        for t in column:
            low = (t.as_py() or "").encode().lower()
            one = np.fromiter((get(m.group(), 0) for m in _WORD.finditer(low)), np.int32)
            ids += [one, [0]]  # a gap no phrase crosses
            sizes.append(len(one))
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        first = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)][:-1]
        rows = [[n, 0, None, None, set(), set(), [], 0] for n in sizes]
        text_of = lambda at: np.searchsorted(first, at, side="right") - 1
        for phrase, label in base:
            at = _stand(flat, phrase)
            for i, p in zip(text_of(at).tolist(), at.tolist()):
                r, p = rows[i], p - int(first[i])
                r[1] += 1
                r[2], r[3] = (p, p) if r[2] is None else (min(r[2], p), max(r[3], p))
                r[4].add(label)
                r[7] = max(r[7], len(phrase))
        for machine, label in machines:
            at = _stand(flat, machine.steps[:machine.lead])
            which = text_of(at)
            for i in np.unique(which).tolist():
                a = int(first[i])
                found = machine.run(flat[a:a + sizes[i]].tolist(), (at[which == i] - a).tolist())
                rows[i][6] += [{"label": label, "start": s, "end": e} for s, e in found]
                if found:
                    rows[i][5].add(label)
                    rows[i][7] = max(rows[i][7], machine.mandatory)
        for r in rows:
            r[5] = sorted(r[4] | r[5])
            r[4] = sorted(r[4])
            r[6] = sorted(r[6], key=lambda x: (x["start"], x["end"], x["label"]))
            r[7] = min(1.0, r[7] / full)
        return rows

    def run(it):
        for b in it:
            rows = scan(b.column(b.num_columns - 1))
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], *[n for n, _ in kinds]])

    own = [f"c{i}" for i in range(len(key))]  # no name of the caller's meets one of ours
    T = annotations.select(*[F.col(c).alias(o) for c, o in zip(key, own)], blank(text).alias("text"))
    schema = T.select(*own).schema
    for f in T.sparkSession.createDataFrame([], RESULT).schema:
        schema = schema.add(f)
    return T.mapInArrow(run, schema).toDF(*key, *[n for n, _ in kinds])
