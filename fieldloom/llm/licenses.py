"""License scans by template markup.

A template is wording with markup: ``[[ ... ]]`` is optional, ``{{n}}``
stands for up to n words of any kind, ``<<a|b>>`` for one of its sides. It is
compiled into an automaton over words, with an empty move around each optional
region and to each side; a text is accepted where its words spell all mandatory
wording without gap, so a license with altered conditions is not. Automata
start only where the template's opening words stand, which plain search finds.

Defined cases: a null text is empty and has no words, places or labels, a
score of 0 and null positions. Null and repeated ids are rows like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import read

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that may introduce a license by name.
_VERBS = ("released", "licensed", "distributed", "available")

#: Wordings of licenses and of the notices that they ask for, in words, with markup.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC = "the software is provided as is and {{20}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{20}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[<<1|a|i>>]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[and]] [[<<2|b|ii>>]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "[[and]] [[<<3|c|iii>>]] neither the name of {{20}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this software is provided by {{20}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{20}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
)
_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_FULL = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _WARRANTY),
    ("isc", f"{_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC}"),
    ("0bsd", f"{_GRANT} {_ISC}"),
    ("bsd-2-clause", f"{_BSD[0]} {_BSD[2]}"),
    ("bsd-3-clause", " ".join(_BSD)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _WARRANTY),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<http|https>> [[www]] mozilla org mpl 2 0"),
    ("proprietary", "copyright [[c]] {{6}} all rights reserved"),
)
#: What follows a verb and ``under``; ``_APACHE`` is the rest of the notice that the license asks for.
_APACHE = "[[the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<http|https>> www apache org licenses license 2 0 [[html]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license]]"
_NAMED = (
    ("mit", "the [[terms of the]] <<mit|expat>> license"),
    ("isc", "the [[terms of the]] isc license"),
    ("bsd", "the [[terms of the]] [[<<new|modified|simplified|2 clause|3 clause>>]] bsd [[<<2 clause|3 clause>>]] license"),
    ("apache-2.0", f"the [[terms of the]] apache license [[version]] 2 0 {_APACHE}"),
    ("mpl-2.0", "the [[terms of the]] mozilla public license [[<<version|v>>]] 2 0"),
    ("cc0-1.0", "[[the]] [[creative commons]] cc0 1 0 [[universal]]"),
)
_GNU = {"gpl": "", "lgpl": "<<lesser|library>>", "agpl": "affero"}
_CC = {"sa": "<<sharealike|share alike>>", "nc": "<<noncommercial|non commercial>>", "nd": "<<noderivatives|no derivatives|noderivs>>"}


def templates() -> tuple[tuple[str, str], ...]:
    """All ``(label, wording)``: full wordings, and named licenses after each verb in each version."""
    out, named = list(_FULL), list(_NAMED)
    for short, kind in _GNU.items():
        for v, words in (("2.0", "2 [[0]]"), ("2.1", "2 1"), ("3.0", "3 [[0]]")):
            gnu = f"gnu {kind} general public license"
            named.append((f"{short}-{v}", f"the [[terms of the]] {gnu} [[as published by the free software foundation]] [[either]] <<version {words}|v{words}>>"))
            which = f"<<either version {words} of the license or at your option any later version|version {words} [[of the license]]>>"
            out.append((f"{short}-{v}", f"is free software you can redistribute it and or modify it under the terms of the {gnu} as published by the free software foundation {which} {{{{6}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {gnu} for more details"))
    for parts in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for v in ("3.0", "4.0"):
            label, number = "-".join(("cc", "by", *parts, v)), v.replace(".", " ")
            named.append((label, f"[[<<a|the>>]] [[creative commons]] cc by {' '.join(parts)} {number} [[license]]"))
            named.append((label, f"[[<<a|the>>]] creative commons attribution {' '.join(_CC[p] for p in parts)} {number} [[<<international|unported>>]] [[license]]"))
    return (*out, *((label, f"{verb} under {rest}") for verb in _VERBS for label, rest in named))


#: Word characters are letters and digits of ASCII and all others above it.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """States in a row; ``words[s]`` moves from s to s+1 (None: any word; empty: never), ``skips[s]`` are empty moves.

    The opening, up to two words before the first markup, must be mandatory.
    """

    def __init__(self, label: str, wording: str) -> None:
        self.label, self.words, self.skips, opened, sides = label, [], {}, [], []
        parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|<<|>>|\||[^\s\[\]{}<>|]+", wording)
        for p in parts:
            if p == "<<":
                sides.append((len(self.words), []))
            elif p == "|":
                start, ends = sides[-1]
                ends.append(len(self.words))
                self.words.append(b"")  # one side doesn't lead into the next
                self.skips.setdefault(start, []).append(len(self.words))
            elif p == ">>":
                for end in sides.pop()[1]:
                    self.skips.setdefault(end, []).append(len(self.words))
            elif p == "[[":
                opened.append(len(self.words))
            elif p == "]]":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
            elif p.startswith("{{"):
                for _ in range(int(p[2:-2])):
                    self.skips.setdefault(len(self.words), []).append(len(self.words) + 1)
                    self.words.append(None)
            else:
                self.words.append(p.encode())
        first = next((i for i, p in enumerate(parts) if p[0] in "[{<"), len(parts))
        self.opening = " ".join(parts[:first][:2]).encode()

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words from ``at``."""
        states, end = self._closed({0}), None
        i = at
        while states:
            if len(self.words) in states:
                end = i
            if i == len(words):
                break
            states = self._closed({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, words[i])})
            i += 1
        return end


#: Automata by their opening, so that each opening is looked for once.
AUTOMATA: dict[bytes, list[Automaton]] = {}
for _template in templates():
    _automaton = Automaton(*_template)
    AUTOMATA.setdefault(_automaton.opening, []).append(_automaton)


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word positions at which a phrase stands; ``joined`` has a space on either side of each word."""
    want, at, word, seen = b" " + phrase + b" ", 0, 0, 0
    while (at := joined.find(want, at)) >= 0:
        word += joined.count(b" ", seen, at)
        yield word
        seen, at = at, at + 1


def inspect(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Number of words, places of base phrases and ``(from, to, label)`` of accepted templates, in words."""
    words = text.translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    base = [(w, label) for phrase, label in PHRASES.items() for w in places(joined, phrase.encode())]
    found = {(w, end, a.label) for opening, some in AUTOMATA.items() for w in places(joined, opening) for a in some if (end := a.match(words, w)) is not None}
    return len(words), sorted(base), sorted(found)


_BASE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, matches)``: base phrases and accepted templates of each whole text, in words from 0."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [inspect(t) for t in b["__text"].to_pylist()]
            base = pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], _BASE)
            found = pa.array([[{"start": s, "stop": e, "label": x} for s, e, x in r[2]] for r in rows], _FOUND)
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array([r[0] for r in rows], pa.int64()), base, found], names=["doc_id", "n_words", "places", "matches"])

    kind = cols.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, matches array<struct<start:long,stop:long,label:string>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and a score for each document: 1 if a template accepts, 0.5 for a phrase alone."""
    f = scan(read(spark, sf_dir, "documents"))
    base = F.transform("places", lambda x: x["label"])
    every = F.concat(base, F.transform("matches", lambda x: x["label"]))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    at = F.transform("places", lambda x: x["word"])
    return f.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"), listed(every).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )
