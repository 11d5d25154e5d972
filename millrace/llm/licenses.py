"""License scan: template markup compiled into token automata.

A template is its mandatory wording with two kinds of markup, as license lists use:
``<<optional>> ... <</optional>>`` may be absent, and ``<<any N>>`` stands for up to
N words of any kind. A template compiles into an automaton over words whose states
are sets of positions; a text is accepted where some run of its words spells all
mandatory words exactly. Runs start only at words that can begin a template. Matches do
not overlap: from left to right the longest run at a word counts, of equal ones the
template that comes first by name.

The templates are whole short licenses, and the notices by which programs and works refer to
the long ones; ``scan`` takes others as a parameter.

Words are ``WORD`` over the text with A-Z lowered. The base phrases of ``PHRASES``
are counted wherever their words stand consecutively.

The score is 1 where a template accepts, 0.5 where only base phrases stand, else 0.

Defined cases: null and empty texts have no words, null first and last words and
empty labels; texts of any length are scanned whole; overlapping phrases all count; a null
doc_id stays null; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.llm.base import map_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

PHRASES = {
    ("mit", "license"): "mit",
    ("apache", "license"): "apache",
    ("general", "public", "license"): "gpl",
}

# The public wording of common licenses and notices, with markup.
_MIT_GRANT = """
    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be
    included in all copies or substantial portions of the Software."""
_BSD_START = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. <<optional>>2.<</optional>> Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution."""
_BSD_END = """
    THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    <<any 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
    NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_START = """
    <<any 12>> is free software<<optional>>;<</optional>> you can redistribute it and/or modify it under the terms of the GNU"""
_GNU_END = """
    as published by the Free Software Foundation<<optional>>;<</optional>> either version <<any 2>> of the License, or (at your
    option) any later version."""
_GNU_WARRANTY = """
    <<optional>><<any 12>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.<</optional>>"""
TEMPLATES = {
    "mit-notice": """
        <<optional>>this <<any 3>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>>
        under the <<optional>>terms of the<</optional>> MIT license""",
    "mit-text": _MIT_GRANT + """
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 12>> BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": _MIT_GRANT,
    "apache-2.0": """
        Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use <<any 4>> except in
        compliance with the License.<</optional>> <<optional>>You may obtain a copy of the License at
        <<any 8>> Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.<</optional>>""",
    "gpl-notice": """
        <<optional>>this <<any 3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> GNU
        General Public License <<optional>>version <<any 2>><</optional>>""",
    "lgpl-notice": """
        <<optional>>this <<any 3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> GNU Lesser
        General Public License <<optional>>version <<any 2>><</optional>>""",
    "agpl-notice": """
        <<optional>>this <<any 3>> is<</optional>> licensed under the <<optional>>terms of the<</optional>> GNU Affero
        General Public License <<optional>>version <<any 2>><</optional>>""",
    "gpl-header": _GNU_START + " General Public License " + _GNU_END + _GNU_WARRANTY,
    "lgpl-header": _GNU_START + " <<optional>>Lesser<</optional>> <<optional>>Library<</optional>> General Public License " + _GNU_END + _GNU_WARRANTY,
    "agpl-header": _GNU_START + " Affero General Public License " + _GNU_END + _GNU_WARRANTY,
    "mpl-2.0": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<optional>>If a copy of the MPL
        was not distributed with this file, You can obtain one at <<any 6>><</optional>>""",
    "epl-2.0": """
        This program and the accompanying materials are made available under the terms of the Eclipse Public License
        <<optional>>v.<</optional>> 2.0""",
    "cc-by": "licensed under <<optional>>a<</optional>> <<optional>>Creative Commons<</optional>> CC BY <<optional>>4.0<</optional>>",
    "cc-by-sa": "licensed under <<optional>>a<</optional>> <<optional>>Creative Commons<</optional>> CC BY-SA <<optional>>4.0<</optional>>",
    "cc-by-nc": "licensed under <<optional>>a<</optional>> <<optional>>Creative Commons<</optional>> CC BY-NC <<optional>>4.0<</optional>>",
    "cc-attribution": """
        This work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> Creative Commons Attribution
        <<optional>>NonCommercial<</optional>> <<optional>>ShareAlike<</optional>> <<any 2>> License""",
    "bsd-2-clause": _BSD_START + _BSD_END,
    "bsd-3-clause": _BSD_START + """
        <<optional>>3.<</optional>> Neither the name of <<any 12>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""" + _BSD_END,
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        <<optional>>THE SOFTWARE IS PROVIDED "AS IS" AND <<any 6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.<</optional>>""",
    "zlib": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "unlicense": """
        This is free and unencumbered software released into the public domain.""",
    "all-rights-reserved": "copyright <<any 8>> all rights reserved",
}

_MARKUP = re.compile(r"<<(/?optional|any (\d+))>>|([^<]+)")


@dataclass(frozen=True)
class Automaton:
    """``words[s]`` is the word that leads from state s to s+1, or None for any; ``skips[s]``: states free to reach."""

    words: tuple[str | None, ...]
    skips: tuple[tuple[int, ...], ...]
    free: tuple[frozenset[int], ...]

    @property
    def starts(self) -> set[str]:
        """The words that an accepted run can begin with; a run never begins with a word of any kind."""
        return {self.words[s] for s in self.free[0] if s < len(self.words)} - {None}

    def accepts(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted run of ``words`` that begins at ``at``, if there is one."""
        states, end, last = self.free[0], None, len(self.words)
        while True:
            if last in states:
                end = at
            if not states or at >= len(words):
                return end
            word, after = words[at], set()
            for s in states:
                if s < last and (self.words[s] is None or self.words[s] == word):
                    after |= self.free[s + 1]
            states, at = frozenset(after), at + 1


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; optional regions may nest."""
    words: list[str | None] = []
    skips: list[set[int]] = [set()]
    opened: list[int] = []
    for m in _MARKUP.finditer(markup):
        if m[1] == "optional":
            opened.append(len(words))
        elif m[1] == "/optional":
            skips[opened.pop()].add(len(words))
        elif m[2]:
            first = len(words)
            for _ in range(int(m[2])):
                words.append(None)
                skips.append(set())
            for s in range(first, len(words)):
                skips[s].add(len(words))
        else:
            for word in words_of(m[3]):
                words.append(word)
                skips.append(set())
    free = []
    for state in range(len(skips)):
        reach, todo = {state}, [state]
        while todo:
            new = skips[todo.pop()] - reach
            reach |= new
            todo += new
        free.append(frozenset(reach))
    return Automaton(tuple(words), tuple(tuple(sorted(s)) for s in skips), tuple(free))


def index(templates: dict[str, str]) -> dict[str, list[tuple[str, Automaton]]]:
    """Automata by the words that can begin them."""
    out: dict[str, list[tuple[str, Automaton]]] = {}
    for label, markup in templates.items():
        automaton = compile_template(markup)
        for word in sorted(automaton.starts):
            out.setdefault(word, []).append((label, automaton))
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def phrases(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every place of a base phrase."""
    found = []
    for phrase, label in PHRASES.items():
        at = -1
        for _ in range(words.count(phrase[-1])):
            at = words.index(phrase[-1], at + 1)
            start = at + 1 - len(phrase)
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                found.append((start, label))
    return found


def matches(words: list[str], by_start: dict[str, list[tuple[str, Automaton]]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the matches, which do not overlap: the longest from left to right."""
    if by_start.keys().isdisjoint(words):
        return []
    out, free = [], 0
    for at, word in enumerate(words):
        if at < free or word not in by_start:
            continue
        ends = ((automaton.accepts(words, at), label) for label, automaton in by_start[word])
        best = min(((-end, label) for end, label in ends if end is not None), default=None)
        if best:
            free = -best[0]
            out.append((at, free, best[1]))
    return out


def examine(text: str | None, by_start: dict[str, list[tuple[str, Automaton]]]) -> tuple:
    """The row of ``scan`` for one text, without its id."""
    words = words_of(text)
    base, found = phrases(words), matches(words, by_start)
    starts = [s for s, _ in base]
    labels = {label for _, label in base}
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {label for *_, label in found})),
        1.0 if found else 0.5 if base else 0.0,
        ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(found)),
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the matches (label:start:end)."""

    def make():
        by_start = index(TEMPLATES if templates is None else templates)
        return lambda rows: [(i, *examine(t, by_start)) for i, t in rows]

    return map_texts(
        docs,
        make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, matches string",
    )
