"""License scans: template markup compiled to token automata, beside a count of fixed phrases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import WORD_BYTES, map_slices, texts

# Phrases and the labels they stand for.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public notices as templates. [[...]] may be left out; <<n>> stands for up to n words of any kind.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "[[the software is]] licensed under the mit license",
        "[[copyright]] [[c]] <<8>> permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "[[copyright]] [[c]] <<8>> permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 [[0]] [[the license]]",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at <<12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "bsd-3-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of <<12>> may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "gpl-2": [
        "[[this work is]] licensed under the [[terms of the]] gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version",
    ],
    "gpl-3": [
        "[[this work is]] licensed under the [[terms of the]] gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version",
    ],
    "lgpl-3": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<8>>"],
    "cc0": ["to the extent possible under law <<12>> has waived all copyright and related or neighboring rights to <<12>>"],
    "cc-by-nc": ["licensed under [[a]] [[creative commons]] cc by nc [[4 0]]", "creative commons attribution noncommercial <<4>> license"],
    "all-rights-reserved": ["[[copyright]] [[c]] <<4>> all rights reserved"],
}


def compile_template(markup: str) -> tuple[list[dict[bytes, set[int]]], list[set[int]], list[set[int]], int]:
    """A template as an automaton over words: steps by word, steps by any word, free steps, and the end state.

    Optional wording gets a free step past it, a replaceable region n states with a step by any
    word and a free step each. All other words are mandatory.
    """
    by_word, by_any, free = [{}], [set()], [set()]

    def state() -> int:
        by_word.append({})
        by_any.append(set())
        free.append(set())
        return len(by_word) - 1

    at = 0

    def follow(words: list[str], at: int) -> int:
        for w in words:
            to = state()
            by_word[at].setdefault(w.encode(), set()).add(to)
            at = to
        return at

    for part in re.findall(r"\[\[.*?\]\]|<<\d+>>|[^\[<]+", markup):
        if part.startswith("[["):
            end = follow(part[2:-2].split(), at)
            free[at].add(end)
            at = end
        elif part.startswith("<<"):
            for _ in range(int(part[2:-2])):
                to = state()
                by_any[at].add(to)
                free[at].add(to)
                at = to
        else:
            at = follow(part.split(), at)
    return by_word, by_any, free, at


def _closed(states: set[int], free: list[set[int]]) -> set[int]:
    todo = list(states)
    while todo:
        for to in free[todo.pop()]:
            if to not in states:
                states.add(to)
                todo.append(to)
    return states


def accepts(automaton, words: list[bytes], start: int) -> int:
    """Where the longest accepted run of words from ``start`` ends; -1 if none is."""
    by_word, by_any, free, end = automaton
    now, at, last = _closed({0}, free), start, -1
    while now:
        if end in now:
            last = at
        if at == len(words):
            break
        step: set[int] = set()
        for s in now:
            step |= by_word[s].get(words[at], set()) | by_any[s]
        now, at = _closed(step, free), at + 1
    return last


def anchor(markup: str) -> list[bytes]:
    """The longest run of mandatory words; a text without it can't match."""
    runs = [x.split() for x in re.split(r"\[\[.*?\]\]|<<\d+>>", markup)]
    return [w.encode() for w in max(runs, key=len)]


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand one after another; line has a space at either end."""
    found, at = [], line.find(phrase)
    counted, word = 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        found.append(word)
        at = line.find(phrase, at + 1)
    return found


def _reach(markup: str, a: list[bytes]) -> int:
    """How many words of a match can stand before its anchor."""
    n = 0
    for part in re.findall(r"\[\[.*?\]\]|<<\d+>>|[^\[<]+", markup):
        if part[0] not in "[<" and [w.encode() for w in part.split()] == a:
            return n
        n += int(part[2:-2]) if part[0] == "<" else len(part.strip("[]").split())
    return n


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, base_places (label, word), matches (label, start and end word of each accepted template).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; all other
    characters separate them. A null text counts as an empty one, without words or matches; matches
    cover whole texts of any length; overlapping places all count; repeated rows and null keys each
    keep their row; other columns are ignored; an empty table gives an empty one.
    """
    base = [(f" {' '.join(p.split())} ".encode(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    marks = [(label, m) for label, all_of in (TEMPLATES if templates is None else templates).items() for m in all_of]
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        compiled = [(label, compile_template(m), a := anchor(m), _reach(m, a)) for label, m in marks]
        keys = [b" " + b" ".join(a) + b" " for _, _, a, _ in compiled]

        def apply(batch):
            out = {"doc_id": batch.column("doc_id"), "n_words": [], "base_places": [], "matches": []}
            for x in texts(batch):
                words = x.encode("utf-8", "replace").translate(WORD_BYTES).split()
                line = b" %b " % b" ".join(words)
                places = [{"label": label, "word": i} for phrase, label in base for i in _places(line, phrase)]
                found = set()
                for (label, automaton, a, reach), k in zip(compiled, keys):
                    before = 0
                    for i in _places(line, k):
                        for start in range(max(before, i - reach), i + 1):
                            if (end := accepts(automaton, words, start)) >= i + len(a):
                                found.add((label, start, end))
                                before = end
                                break
                out["n_words"].append(len(words))
                out["base_places"].append(places)
                out["matches"].append([{"label": a, "start_word": b, "end_word": c} for a, b, c in sorted(found)])
            return out

        return apply

    return map_slices(rows, make, "doc_id bigint, n_words bigint, base_places array<struct<label:string,word:bigint>>, matches array<struct<label:string,start_word:bigint,end_word:bigint>>")
