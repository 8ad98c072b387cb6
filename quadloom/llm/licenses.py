"""License scans by template-markup matching.

A template is wording with marked regions: text in [[...]] is optional, {{n}} stands
for up to n replaceable words, everything else is mandatory. A template compiles
into an automaton over words; a text matches where the automaton reads all mandatory
words exactly, one after another. Words are lower-cased runs of letters, digits and
non-ASCII characters, so punctuation and line breaks never matter.

Numpy finds all places of the fixed phrases and of every template's first words in a
whole batch; an automaton only runs from those places, and never past its longest
match. Null and empty texts have no words and no labels; rows are judged one by one,
so repeated rows and null ids keep their places; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._arrow import ALNUM, slices, texts_of, words

#: Fixed values of the contract: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and public wording. -text is a license (or its standard notice) from grant to disclaimer, -grant its
#: opening alone, -notice a mention. Our labels have these endings, so base labels stay as they are.
TEMPLATES = {
    "apache-notice": "licensed under the apache license",
    "cc-notice": "[[this work is ]]licensed under [[a ]][[the ]][[creative commons attribution ]]cc by",
    "gpl-notice": "[[this work is ]]licensed under the [[gnu ]][[lesser ]][[affero ]]general public license",
    "mit-notice": "released under the mit license",
    "reserved-notice": "[[copyright {{6}} ]]all rights reserved",
    "spdx-notice": "spdx license identifier",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{3}} to deal in {{3}} without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-grant": "this {{1}} is free software[[ you can]] redistribute it and or modify it under the terms of the gnu [[lesser ]][[affero ]]general public license as published by the free software foundation either version {{3}} of the license or[[ at your option]] any later version",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{3}} to deal in {{3}} without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of {{3}} and to permit persons to whom {{3}} is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph ]]shall be included in all copies or substantial portions of {{3}}
        {{3}} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall {{10}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with {{3}} or the use
        or other dealings in""",
    "isc-text": """permission to use copy modify and [[or ]]distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice
        appear in all copies the software is provided as is and {{10}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{10}}
        be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1 ]]redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer [[2 ]]redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution
        [[{{1}} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{12}} ]]
        [[{{1}} neither the name of {{12}} nor the names of {{3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission ]]
        this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event [[will the authors ]][[shall the authors ]]be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        [[1 ]]the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product
        documentation would be appreciated but is not required [[2 ]]altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3 ]]this
        notice may not be removed or altered from any source distribution""",
    "boost-text": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use
        reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject
        to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies
        of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a
        source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form
        or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication
        to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law""",
    "apache-text": """licensed under the apache license version 2 0 [[the license ]]you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} unless
        required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "gpl-text": """this {{1}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser ]][[affero ]]general public license as published by the free software foundation
        either version {{3}} of the license or at your option any later version this {{1}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu [[lesser ]][[affero ]]general public license for more details you should have received a copy of the gnu [[lesser ]][[affero ]]
        general public license along with this""",
}
#: Score by a label's ending; base phrases alone give BASE_SCORE.
SCORES, BASE_SCORE = {"text": 1.0, "grant": 0.9, "notice": 0.75}, 0.5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton(NamedTuple):
    """States 0..n; steps[s] lists (word or None for any, next state); skips[s] the states that cost no word."""

    steps: list[list[tuple[str | None, int]]]
    skips: list[list[int]]
    first: list[tuple[str, ...]]

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def run(self, read: list[str]) -> int:
        """Words of the shortest match that ends in the last state, or 0."""
        now = self.closure({0})
        for k, word in enumerate(read, 1):
            now = self.closure({t for s in now for w, t in self.steps[s] if w is None or w == word})
            if not now:
                return 0
            if len(self.steps) - 1 in now:
                return k
        return 0

    @property
    def longest(self) -> int:
        return len(self.steps) - 1


def compiled(template: str) -> Automaton:
    """Marked wording as an automaton; first: the words a match can begin with."""
    steps: list[list[tuple[str | None, int]]] = [[]]
    skips: list[list[int]] = [[]]

    def read(word: str | None) -> None:
        steps.append([])
        skips.append([])
        steps[-2].append((word, len(steps) - 1))

    opened: list[int] = []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template):
        if part == "[[":
            opened.append(len(steps) - 1)
        elif part == "]]":
            skips[opened.pop()].append(len(steps) - 1)
        elif part.startswith("{{"):
            begin = len(steps) - 1
            for _ in range(int(part[2:-2])):
                read(None)
            for state in range(begin, len(steps) - 1):
                skips[state].append(len(steps) - 1)
        else:
            read(part)
    out = Automaton(steps, skips, [])
    first = sorted({w for s in out.closure({0}) for w, _ in steps[s] if w is not None})
    return out._replace(first=[(w,) for w in first])


AUTOMATA = {label: compiled(t) for label, t in TEMPLATES.items()}


class Anchor(NamedTuple):
    """The longest run of mandatory words, which every match holds, and how few and many words a match has before it."""

    words: tuple[str, ...]
    least: int
    most: int


def anchor_of(template: str) -> Anchor:
    runs, now, depth, least, most = [], [], 0, 0, 0
    for part in [*re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template), "[["]:
        word = part[:2] not in ("[[", "]]", "{{")
        if word and not depth:
            now.append(part)
            continue
        if now:  # a run of mandatory words ends
            runs.append(Anchor(tuple(now), least, most))
            least, most, now = least + len(now), most + len(now), []
        if part.startswith("{{"):
            most += int(part[2:-2])
        elif word:
            most += 1
        else:
            depth += 1 if part == "[[" else -1
    return max(runs, key=lambda a: len(a.words))


ANCHORS = {label: anchor_of(t) for label, t in TEMPLATES.items()}


def places(phrase: tuple[str, ...], code: dict[str, int], codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another in one text."""
    k = len(phrase)
    if len(codes) < k or any(w not in code for w in phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(codes[: len(codes) - k + 1] == code[phrase[0]])
    for j in range(1, k):
        at = at[codes[at + j] == code[phrase[j]]]
    return at[text_of[at] == text_of[at + k - 1]]


def scan(texts: pa.StringArray) -> dict[str, list]:
    """Counts, places, labels and score of each text."""
    w = words(texts, ALNUM)
    n, text_of = len(texts), w.text_of
    needed = sorted({x for p in PHRASES for x in p.split()} | {x for a in ANCHORS.values() for x in a.words} | {x for a in AUTOMATA.values() for (x,) in a.first})
    index = pc.index_in(pa.array(needed, pa.string()), w.vocab) if len(w.vocab) else pa.nulls(len(needed), pa.int32())
    code = {x: i for x, i in zip(needed, index.to_pylist(), strict=True) if i is not None}
    n_base, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
    labels: list[set[str]] = [set() for _ in range(n)]
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in PHRASES.items():
        at = places(tuple(phrase.split()), code, w.codes, text_of)
        owner, place = text_of[at], at - w.bounds[text_of[at]]
        np.add.at(n_base, owner, 1)
        np.minimum.at(first, owner, place)
        np.maximum.at(last, owner, place)
        for i in owner.tolist():
            base[i].add(label)
    for label, automaton in AUTOMATA.items():
        anchor = ANCHORS[label]
        for place in places(anchor.words, code, w.codes, text_of).tolist():
            i = int(text_of[place])
            if label in labels[i]:
                continue
            low, high = max(int(w.bounds[i]), place - anchor.most), int(w.bounds[i + 1])
            read = w.flat[low : min(high, place + automaton.longest)].to_pylist()
            for begin in range(place - low - anchor.least, -1, -1):
                if (read[begin],) in automaton.first and begin + automaton.run(read[begin : begin + automaton.longest]) >= place - low + len(anchor.words):
                    labels[i].add(label)
                    break
    return {
        "n_words": w.counts, "n_base": n_base,
        "first_word": [int(x) if c else None for x, c in zip(first, n_base, strict=True)],
        "last_word": [int(x) if c else None for x, c in zip(last, n_base, strict=True)],
        "base_labels": [",".join(sorted(b)) for b in base],
        "labels": [",".join(sorted(b | m)) for b, m in zip(base, labels, strict=True)],
        "score": [max([SCORES[x.rsplit("-", 1)[1]] for x in m] + [BASE_SCORE if b else 0.0]) for b, m in zip(base, labels, strict=True)],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts and places of the base phrases, labels, and a score by how much of a license was matched: SCORES, or a half for base phrases alone."""
    cols = docs.select(F.col(id_col), F.col(text))
    names = [part.strip().split()[0] for part in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            got = scan(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c], t) for c, t in zip(names, TYPES, strict=True))], [batch.schema.names[0], *names])

    return cols.mapInArrow(run, f"`{id_col}` {cols.schema[0].dataType.simpleString()}, {SCHEMA}")
