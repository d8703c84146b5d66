"""License scans by template-markup matching.

A template is the mandatory wording of a notice with two kinds of markup:
``[[ ... ]]`` is an optional region (may nest), ``{{name:least-most}}`` a
replaceable region of so many words, ``#`` any number.  Each template compiles to a token
automaton (Thompson's construction over words); all start together, and the
deterministic states are built as texts need them and kept.  A place is accepted
where every mandatory word stands in order with nothing else between but
optional and replaceable regions; the longest match from each start counts.

Texts are read whole inside Arrow batches, row by row, with memory of one text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places count, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of common notices (label, template), one-line notices first, then whole licence texts.
_NO_WARRANTY = (
    "this software is provided by the {{who:1-12}} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the {{who:1-12}} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage")
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution ")
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by", "licensed under [[a]] cc by # [[#]]"),
    ("cc-by-nc", "licensed under [[a]] cc by nc # [[#]]"),
    ("cc-by-nc-nd", "licensed under [[a]] cc by nc nd # [[#]]"),
    ("cc-by-nc-sa", "licensed under [[a]] cc by nc sa # [[#]]"),
    ("cc-by-sa", "licensed under [[a]] cc by sa # [[#]]"),
    ("cc0", "has waived all copyright and related or neighboring rights to"),
    ("gpl", "[[this {{what:1-3}} is]] licensed under the gnu [[{{kind:1-1}}]] general public license [[version # [[#]]]]"),
    ("isc", "released under the isc license"),
    ("isc", "licensed under the isc license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("reserved", "[[copyright [[c]] {{holder:1-8}}]] all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                   "obtain a copy of the license at {{place:1-12}} unless required by applicable law or agreed to in writing software distributed "
                   "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
                   "license for the specific language governing permissions and limitations under the license"),
    ("bsd-2-clause", _BSD_START + _NO_WARRANTY),
    ("bsd-3-clause", _BSD_START + "[[3]] neither the name of {{who:1-12}} nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission " + _NO_WARRANTY),
    ("gpl", "this {{what:1-3}} is free software you can redistribute it and or modify it under the terms of the gnu [[{{kind:1-1}}]] general public "
            "license as published by the free software foundation either version # [[#]] of the license or at your option any later version this "
            "{{what:1-3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
            "merchantability or fitness for a particular purpose see the gnu [[{{kind:1-1}}]] general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
            "above copyright notice and this permission notice appear in all copies the software is provided as is and {{who:1-6}} disclaims all "
            "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{who:1-6}} be "
            "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
            "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this "
            "software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
            "the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in "
            "all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
            "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
            "{{who:1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
            "or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
                "file you can obtain one at {{place:1-10}}"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                  "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the {{who:1-4}} be held liable for any damages "
             "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
             "applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must "
             "not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment "
             "in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and "
             "must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"\[\[|\#|\]\]|\{\{\w+:(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
_OTHER, _NUMBER = 0, -1                       # words that no template names; of these, numbers


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII bytes."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class TemplateAutomaton:
    """All templates as one automaton over word numbers, with lazily built deterministic states.

    Templates begin with a mandatory or optional word, so most words of a text
    begin nothing.
    """

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.on: list[dict[int | None, set[int]]] = []     # word number, _NUMBER, or None for any word
        self.free: list[set[int]] = []                     # moves without a word
        self.accepts: dict[int, str] = {}
        self.sets: list[frozenset[int]] = []               # deterministic states
        self.numbered: dict[frozenset[int], int] = {}
        self.labels: list[list[str]] = []
        self.moves: dict[tuple[int, int], int] = {}
        starts = set()
        for label, template in templates:
            first, last = self._compile(template)
            self.accepts[last] = label
            starts.add(first)
        self.digits = {n for w, n in self.vocabulary.items() if w.isdigit()} | {_NUMBER}
        self.start = self._numbered(starts)
        self.first = {n for n in [*self.vocabulary.values(), _NUMBER, _OTHER] if self.step(self.start, n) >= 0}

    def _state(self) -> int:
        self.on.append({})
        self.free.append(set())
        return len(self.on) - 1

    def _compile(self, template: str) -> tuple[int, int]:
        first = at = self._state()
        opened: list[int] = []

        def word(key: int | None) -> None:
            nonlocal at
            nxt = self._state()
            self.on[at].setdefault(key, set()).add(nxt)
            at = nxt

        for token in _MARK.finditer(template):
            if token[0] == "[[":
                opened.append(at)
            elif token[0] == "]]":
                self.free[opened.pop()].add(at)
            elif token[0] == "#":
                word(_NUMBER)
            elif token[1]:
                ends = []
                for n in range(int(token[2])):
                    if n >= int(token[1]):
                        ends.append(at)
                    word(None)
                for e in ends:
                    self.free[e].add(at)
            else:
                word(self.vocabulary.setdefault(token[0].encode(), len(self.vocabulary) + 1))
        if opened:
            raise ValueError(f"an optional region does not end: {template}")
        return first, at

    def _numbered(self, states: set[int]) -> int:
        """The deterministic state of ``states`` and all they reach without a word; -1 for none."""
        todo = list(states)
        while todo:
            new = self.free[todo.pop()] - states
            states |= new
            todo += new
        if not states:
            return -1
        key = frozenset(states)
        if key not in self.numbered:
            self.numbered[key] = len(self.sets)
            self.sets.append(key)
            self.labels.append(sorted({self.accepts[s] for s in key if s in self.accepts}))
        return self.numbered[key]

    def step(self, state: int, n: int) -> int:
        to = self.moves.get((state, n))
        if to is None:
            reached: set[int] = set()
            for s in self.sets[state]:
                on = self.on[s]
                reached |= on.get(None, set()) | on.get(n, set()) | (on.get(_NUMBER, set()) if n in self.digits else set())
            to = self.moves[state, n] = self._numbered(reached)
        return to

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, start, end), end exclusive: the longest match of each label from each start
        that is not inside the label's match before."""
        known = self.vocabulary
        numbers = [known[w] if w in known else _NUMBER if w.isdigit() else _OTHER for w in words]
        out: list[tuple[str, int, int]] = []
        covered: dict[str, int] = {}
        first, step = self.first, self.step
        for at, n in enumerate(numbers):
            if n not in first:
                continue
            longest: dict[str, int] = {}
            state, end = step(self.start, n), at + 1
            while state >= 0:
                for label in self.labels[state]:
                    longest[label] = end
                if end == len(numbers):
                    break
                state, end = step(state, numbers[end]), end + 1
            for label in sorted(longest):
                if longest[label] > covered.get(label, 0):
                    covered[label] = longest[label]
                    out.append((label, at, longest[label]))
        return out


def base_places(words: list[bytes]) -> list[tuple[str, int]]:
    """(label, start) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at:at + len(parts)] == parts:
                out.append((label, at))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, matches (``label:start:end``, words, by start then label).

    ``score``: 1 where a template is accepted, 0.5 where only a phrase stands, else 0.
    Null and empty texts have no words and score 0; repeated rows stay; null ids
    are passed on; other columns are not read.
    """
    automaton = TemplateAutomaton(templates)

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, "
                  "labels string, score double, matches string")
    def scanned(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            words = words_of(t)
            base, found = base_places(words), automaton.matches(words)
            own = {label for label, _ in base}
            starts = [at for _, at in base]
            rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted(own)), ",".join(sorted(own | {f[0] for f in found})),
                         1.0 if found else 0.5 if base else 0.0, ",".join(f"{a}:{b}:{c}" for a, b, c in sorted(found, key=lambda f: (f[1], f[0])))))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scanned(F.col("text")).alias("scan")).select("doc_id", "scan.*")
