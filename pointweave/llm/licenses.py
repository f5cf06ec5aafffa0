"""License scan by template-markup matching.

A template is a statement of a license or a whole notice in markup: plain words are mandatory, `<<optional>> ... <</optional>>`
may be missing, `<<var N>>` stands for up to N words of any kind. Each template is compiled into a
token automaton; a text is accepted where the automaton, started at a word, reaches its end, so all
mandatory wording has matched exactly and in order. Before an automaton is run, its longest run of
mandatory words must occur in the text: a substring search that nearly all documents fail.

Results in special cases: a null or empty text has no words, no labels, score 0.0 and null
positions; texts are read whole, whatever their length; rows are independent, so repeated rows give
repeated results and an empty table an empty one; of accepted texts that start at one word the
longest counts; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table, texts_of

#: Phrases of the base scan with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: The wording of whole notices in markup, as their publishers give it.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
<<optional>>the software<</optional>> to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>>
shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the <<var 12>> be liable for any claim damages or
other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall <<var 12>> be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of
or in connection with the use or performance of this software"""
BSD_CONDITIONS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<var 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<var 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
BSD_NAMES = """<<var 1>> neither the name of <<var 16>> nor the names of <<var 4>> contributors may be used to endorse or promote products derived
from this software without specific prior written permission"""
BSD_DISCLAIMER = """this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at <<var 12>> unless required by applicable law or agreed to in writing software distributed under the
license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
specific language governing permissions and limitations under the license"""
GNU = """<<var 6>> is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license
<<optional>>version <<var 2>><</optional>> as published by the free software foundation
<<optional>>either<</optional>> <<optional>>version <<var 2>> of the license<</optional>> <<optional>>or <<optional>>at your option<</optional>> any later version<</optional>>
<<var 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
fitness for a particular purpose see the gnu {0} general public license for more details"""
UNLICENSE = """this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
for any purpose commercial or non commercial and by any means"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
applications and to alter it and redistribute it freely subject to the following restrictions
<<var 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this
software in a product an acknowledgment in the product documentation would be appreciated but is not required
<<var 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
<<var 1>> this notice may not be removed or altered from any source distribution"""
MPL = """this source code form is subject to the terms of the mozilla public license v 2 0
if a copy of the mpl was not distributed with this file you can obtain one at"""

#: Statements and whole notices with their labels. A statement names a licence; a notice grants one, so all of its mandatory wording must be there.
TEMPLATES = (
    ("mit", "<<optional>>this <<var 3>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 <<optional>>the license<</optional>>"),
    ("gpl", "<<optional>>this <<var 3>> is<</optional>> licensed under the gnu general public license <<optional>>version <<var 1>><</optional>>"),
    ("lgpl", "<<optional>>this <<var 3>> is<</optional>> licensed under the gnu lesser general public license <<optional>>version <<var 1>><</optional>>"),
    ("cc-by", "licensed under a creative commons attribution <<var 4>> license"),
    ("cc-by-nc", "<<optional>>licensed under<</optional>> cc by nc <<optional>>sa<</optional>> <<optional>><<var 2>><</optional>>"),
    ("copyright", "copyright <<optional>>c<</optional>> <<var 6>> all rights reserved"),
    ("mit", MIT),
    ("isc", ISC),
    ("bsd-2", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("apache-2", APACHE),
    ("gpl", GNU.replace(" {0}", "")),
    ("lgpl", GNU.format("lesser")),
    ("agpl", GNU.format("affero")),
    ("unlicense", UNLICENSE),
    ("zlib", ZLIB),
    ("mpl-2", MPL),
)

#: A-Z lowered; every byte below 128 that is no letter or digit becomes a space. Bytes of longer characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

MARK = re.compile(r"<<(/?\w+)(?: (\d+))?>>|([^\s<]+)")


class Automaton:
    """States 0..end; a state has epsilon edges and at most one edge that reads a word (None: any word)."""

    def __init__(self, template: str):
        self.free: list[list[int]] = [[]]
        self.reads: list[tuple[bytes | None, int] | None] = [None]
        opened, runs, run, depth = [], [], [], 0
        for kind, most, word in MARK.findall(template):
            here = len(self.free) - 1
            if word:
                self._step(word.encode())
                if not depth:
                    run.append(word)
                    continue
            elif kind == "optional":
                opened.append(here)
                depth += 1
            elif kind == "/optional":
                self.free[opened.pop()].append(here)
                depth -= 1
            elif kind == "var":
                starts = [here, *(self._step(None) for _ in range(int(most)))]
                for s in starts[:-1]:
                    self.free[s].append(starts[-1])
            else:
                raise ValueError(f"unknown markup {kind!r}")
            if run:
                runs.append(" ".join(run))
                run = []
        runs += [" ".join(run)] if run else []
        if opened or not runs:
            raise ValueError("a template needs mandatory words, and an end for each optional part")
        self.end = len(self.free) - 1
        self.needed = f" {max(runs, key=len)} ".encode()
        self.closed = [self._closure(s) for s in range(len(self.free))]
        self.first = {self.reads[s][0] for s in self.closed[0] if self.reads[s]}

    def _step(self, word: bytes | None) -> int:
        self.reads[-1] = (word, len(self.free))
        self.free.append([])
        self.reads.append(None)
        return len(self.free) - 1

    def _closure(self, state: int) -> frozenset[int]:
        found, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted text that starts at word `at`; -1 if none does."""
        states, best = self.closed[0], -1
        for i in range(at, len(words)):
            states = frozenset().union(*(self.closed[r[1]] for s in states if (r := self.reads[s]) and r[0] in (None, words[i])))
            if not states:
                break
            if self.end in states:
                best = i + 1
        return best


@lru_cache(maxsize=8)
def compiled(templates: tuple = TEMPLATES) -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(markup)) for label, markup in templates)


def places(shown: bytes, phrase: str) -> list[int]:
    """Words before each place of the phrase in text of the form b' word word '."""
    want, found, at, seen, words = f" {phrase} ".encode(), [], -1, 0, 0
    while (at := shown.find(want, at + 1)) >= 0:
        words += shown.count(b" ", seen, at)
        seen = at
        found.append(words)
    return found


def scan(text: bytes | str, templates: tuple = TEMPLATES, base: tuple = BASE) -> dict:
    """All that is found in one text: base places, accepted spans (label, first word, end) and the share of words they cover."""
    words = (text.encode() if isinstance(text, str) else text).translate(WORDS).split()
    shown = b" " + b" ".join(words) + b" "
    spans = [(label, at, at + len(phrase.split())) for phrase, label in base for at in places(shown, phrase)]
    accepted = []
    for label, automaton in compiled(templates):
        if automaton.needed in shown:
            anywhere = None in automaton.first
            accepted += [(label, i, end) for i, w in enumerate(words) if (anywhere or w in automaton.first) and (end := automaton.longest(words, i)) > 0]
    covered, reach = 0, 0
    for _, start, end in sorted(spans + accepted, key=lambda x: x[1:]):
        covered += max(0, end - max(start, reach))
        reach = max(reach, end)
    return {"n_words": len(words), "base": spans, "accepted": accepted, "score": covered / len(words) if words else 0.0}


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: base places, labels of phrases and templates, spans (label, first word, words) and the covered share."""

    def run(texts: list[str], rest: dict) -> dict:
        found = [scan(x, templates) for x in texts]
        starts = [[s for _, s, _ in f["base"]] for f in found]
        return {
            "doc_id": rest["doc_id"],
            "n_words": [f["n_words"] for f in found],
            "n_base": [len(s) for s in starts],
            "first_word": [min(s, default=None) for s in starts],
            "last_word": [max(s, default=None) for s in starts],
            "base_labels": [",".join(sorted({x[0] for x in f["base"]})) for f in found],
            "labels": [",".join(sorted({x[0] for x in f["base"] + f["accepted"]})) for f in found],
            "score": [f["score"] for f in found],
            "spans": [[{"label": a, "start": s, "words": e - s} for a, s, e in f["accepted"]] for f in found],
        }

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, words: long>>"
    return map_texts(texts_of(docs), "text", run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
