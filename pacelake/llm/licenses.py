"""License scans by template-markup matching.

A template is a license wording in which ``<<beginOptional>> ... <<endOptional>>`` may be
left out (regions may be nested) and ``<<var;name="x";match="regex";words="1-6">>`` stands
for that many words, each of which the expression matches whole.  ``compile_template``
makes a token automaton of it: states with a word, any of some words, or nothing on their
edges.  A text is accepted where its words run through the automaton, so that all
mandatory wording matches exactly and in order; blanks, case (A-Z) and marks don't count.

A wording of ``EXCLUDED`` right after an accepted text takes its label away, as "or later" does for -only.

Base labels come from phrases alone.  Texts are scanned one by one in a projection, without
a shuffle; the templates are a fixed few, sent with the task.  A template is tried only
in texts that hold all its mandatory words, from each place of one of its first words.

Null and empty texts have no words and no labels.  Repeated rows, null ids and extra
columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, words_of

#: Base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_HOLDER = '<<var;name="holder";match=".+";words="1-12">>'
_WORK = '<<beginOptional>>This <<var;name="kind";match="[a-z]+";words="1-2">> is <<endOptional>>'
_ITEM = {n: f"<<beginOptional>>{n}. <<endOptional>>" for n in (1, 2, 3)}
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,' \
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND' \
    f" <<beginOptional>>NONINFRINGEMENT<<endOptional>><<beginOptional>>NON-INFRINGEMENT<<endOptional>>. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE," \
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:" \
    f" {_ITEM[1]}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer." \
    f" {_ITEM[2]}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = f'THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.' \
    f" IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;" \
    " OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE," \
    " EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,' \
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR" \
    " PERFORMANCE OF THIS SOFTWARE."


def _gnu(name: str, version: str, later: bool) -> str:
    """The notice that the GNU licenses tell authors to use."""
    which = f"either version {version} of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version." if later else f"version {version} of the License<<beginOptional>> only<<endOptional>>."
    return f"This <<var;name=\"kind\";match=\"[a-z]+\";words=\"1-2\">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}"


def _creative_commons(elements: str, named: bool) -> str:
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    what = "Creative Commons " + "-".join(words[x] for x in elements.split("-")) if named else f"<<beginOptional>>Creative Commons <<endOptional>>CC {elements}"
    return f"{_WORK}licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>{what} 4.0 <<beginOptional>>International <<beginOptional>>License<<endOptional>><<endOptional>>"


_CC = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")

#: Templates with their labels (SPDX identifiers), after the licenses' own notices and whole texts.
#: ``-text`` is a license's whole wording, ``-notice`` the notice that it tells authors to use, ``-name`` its long name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License."
    " <<beginOptional>>You may obtain a copy of the License at <<var;name=\"address\";match=\"[a-z0-9]+\";words=\"1-8\">><<endOptional>><<endOptional>>",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    " You may obtain a copy of the License at <<var;name=\"address\";match=\"[a-z0-9]+\";words=\"1-8\">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    **{f"CC-{x}-4.0": _creative_commons(x, False) for x in _CC},
    **{f"CC-{x}-4.0-name": _creative_commons(x, True) for x in _CC},
    "GPL-3.0-only": f"{_WORK}licensed under the GNU General Public License, version 3<<beginOptional>>.0<<endOptional>><<beginOptional>> only<<endOptional>>",
    "GPL-2.0-only": f"{_WORK}licensed under the GNU General Public License, version 2<<beginOptional>>.0<<endOptional>><<beginOptional>> only<<endOptional>>",
    **{f"{short}-{v}.{m}-or-later": _gnu(name, v if m == "0" else f"{v}.{m}", True) for short, name, v, m in (("GPL", "General Public License", "2", "0"), ("GPL", "General Public License", "3", "0"), ("LGPL", "Lesser General Public License", "2", "1"), ("LGPL", "Lesser General Public License", "3", "0"), ("AGPL", "Affero General Public License", "3", "0"))},
    **{f"{short}-{v}.{m}-only-notice": _gnu(name, v if m == "0" else f"{v}.{m}", False) for short, name, v, m in (("GPL", "General Public License", "2", "0"), ("GPL", "General Public License", "3", "0"), ("LGPL", "Lesser General Public License", "2", "1"), ("LGPL", "Lesser General Public License", "3", "0"), ("AGPL", "Affero General Public License", "3", "0"))},
    **{f"GPL-{v}.0-or-later-name": f"{_WORK}licensed under the GNU General Public License, version {v}<<beginOptional>>.0<<endOptional>> or <<beginOptional>>(at your option) <<endOptional>><<beginOptional>>any <<endOptional>>later" for v in "23"},
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name=\"address\";match=\"[a-z0-9]+\";words=\"1-8\">>",
    "MIT": "<<beginOptional>><<beginOptional>>This <<var;name=\"kind\";match=\"[a-z]+\";words=\"1-2\">> is <<endOptional>>released <<endOptional>>under the MIT License"
    " <<beginOptional>>Copyright <<beginOptional>>(c) <<endOptional>><<var;name=\"holder\";match=\".+\";words=\"1-12\">> all rights reserved<<endOptional>>",
    "MIT-text": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software."
    f" {_MIT_DISCLAIMER}",
    "MIT-0-text": f"{_MIT_GRANT}. {_MIT_DISCLAIMER}",
    "X11-text": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    f" {_MIT_DISCLAIMER} Except as contained in this notice, the name of {_HOLDER} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {_HOLDER}",
    "JSON-text": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    f" The Software shall be used for Good, not Evil. {_MIT_DISCLAIMER}",
    "BSD-2-Clause-text": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-text": f"{_BSD_CONDITIONS} {_ITEM[3]}Neither the name of {_HOLDER} may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "ISC-text": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",
    "0BSD-text": f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",
}
#: Wordings that make another license of what is accepted right before them.
_LATER = ("or <<beginOptional>>(at your option) <<endOptional>><<beginOptional>>any <<endOptional>>later", "and <<beginOptional>>any <<endOptional>>later", "or newer", "or above", "or higher", "or greater")
EXCLUDED = {
    **{x: (*_LATER, *(f"of the License {y}" for y in _LATER)) for x in TEMPLATES if "-only" in x},
    "MIT-text": ("Except as contained in this notice, the name of",),
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
FOUND = "doc_id long, n_words long, base_places array<int>, base_labels array<string>, found array<struct<label string, start int, end int>>"


class Var:
    """A replaceable region: from low to high words, each matched by the expression."""

    def __init__(self, spec: str):
        fields = dict(re.findall(r'(\w+)="([^"]*)"', spec))
        self.match = fields.get("match", ".+")
        low, _, high = fields.get("words", "1-10").partition("-")
        self.low, self.high = int(low), int(high or low)


def parse(template: str) -> list:
    """Words (bytes), Var and lists (optional regions) in order."""
    top: list = []
    open_regions = [top]
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            open_regions[-1] += words_of(part)
        elif part == "beginOptional":
            open_regions.append([])
        elif part == "endOptional":
            if len(open_regions) < 2:
                raise ValueError("endOptional without beginOptional")
            region = open_regions.pop()
            open_regions[-1].append(region)
        else:
            open_regions[-1].append(Var(part))
    if len(open_regions) > 1:
        raise ValueError("beginOptional without endOptional")
    return top


class Automaton:
    """``edges[state]`` has (word, expression or None, next state) triples; ``skips[state]`` the states reached without a word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, re.Pattern | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.needed: set[bytes] = set()
        self.final = self._add(parse(template), 0, True)
        self.start = self._closed({0})
        self.first = {w for s in self.start for w, _, _ in self.edges[s] if w is not None}
        if any(w is None for s in self.start for w, _, _ in self.edges[s]) or self.final in self.start:
            raise ValueError("a template has to begin with wording, after optional regions at most")

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _add(self, parts: list, at: int, mandatory: bool) -> int:
        for p in parts:
            if isinstance(p, bytes):
                if mandatory:
                    self.needed.add(p)
                end = self._state()
                self.edges[at].append((p, None, end))
            elif isinstance(p, Var):
                expression, steps = re.compile(p.match), [at]
                for _ in range(p.high):
                    steps.append(self._state())
                    self.edges[steps[-2]].append((None, expression, steps[-1]))
                end = self._state()
                for s in steps[p.low :]:
                    self.skips[s].append(end)
            else:
                inner, end = self._state(), self._state()
                self.skips[at] += [inner, end]
                self.skips[self._add(p, inner, False)].append(end)
            at = end
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def end_of(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest run of words from ``at`` that the template accepts."""
        states, end = self.start, None
        for k in range(at, len(words)):
            w = words[k]
            text = w.decode("utf-8", "replace")
            states = self._closed({z for s in states for own, expression, z in self.edges[s] if own == w or own is None and expression.fullmatch(text)})
            if not states:
                break
            if self.final in states:
                end = k + 1
        return end

    def matches(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int]]:
        """Start and end of the accepted runs; each begins after the one before it has ended."""
        if not self.needed <= present:
            return []
        out, k = [], 0
        while k < len(words):
            if words[k] in self.first and (end := self.end_of(words, k)) is not None:
                out.append((k, end))
                k = end
            else:
                k += 1
        return out


def compile_template(template: str) -> Automaton:
    return Automaton(template)


def places(words: list[bytes], phrase: list[bytes], present: set[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i] == phrase[0] and words[i : i + n] == phrase] if present.issuperset(phrase) else []


def _scan(templates: dict[str, str], base: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automata = {label: Automaton(t) for label, t in templates.items()}
    excluded = {label: [Automaton(t) for t in EXCLUDED[label]] for label in templates if label in EXCLUDED}
    phrases = [(words_of(p), label) for p, label in base.items()]
    for b in slices(batches):
        cols: list[list] = [[], [], [], []]
        for text in b.column("text").to_pylist():
            words = words_of(text)
            present = set(words)
            at = [(k, label) for p, label in phrases for k in places(words, p, present)]
            found = [{"label": label, "start": s, "end": e} for label, a in automata.items() for s, e in a.matches(words, present) if not any(x.end_of(words, e) for x in excluded.get(label, ()))]
            for c, v in zip(cols, (len(words), sorted(k for k, _ in at), sorted({x for _, x in at}), found), strict=True):
                c.append(v)
        span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(span))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "base_places", "base_labels", "found"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base_places (starts of base phrases), base_labels and found (labels and word spans of accepted templates)."""
    for t in (templates or TEMPLATES).values():
        compile_template(t)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(partial(_scan, templates or TEMPLATES, base or BASE), FOUND)
