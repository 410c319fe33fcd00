"""License scans: template markup compiled to token automata.

A template is wording with markup: ``<<optional>>...<</optional>>`` may be left out,
``<<var;words=a-b>>`` stands for a to b arbitrary words. It is accepted where the
mandatory words stand consecutively but for such regions. The base phrases are
templates without markup.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_TABLE, id_text, sliced, words

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The method's own templates by label. Each begins with a mandatory word.
TEMPLATES = {
    "text-mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " <<optional>>(the \"Software\")<</optional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>>"
        " shall be included in all copies or substantial portions of the Software."
    ),
    "text-bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " <<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        " in the documentation and/or other materials provided with the distribution."
    ),
    "text-isc": (
        "Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\"); you may not use this file except in compliance with the License<</optional>>",
    "notice-gpl": (
        "licensed under the <<optional>>terms of the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>>,"
        " <<optional>>either<</optional>> version <<var;words=1-1>>"
    ),
    "notice-mit": "released under the <<optional>>terms of the<</optional>> MIT License",
    "notice-cc-by": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY <<var;words=0-2>> <<optional>>4.0<</optional>>",
    "notice-copyright": "all rights reserved copyright <<var;words=1-8>> <<optional>>inc<</optional>> unauthorized copying of this file is strictly prohibited",
}

#: The warranty wording that follows the grants in the licences' full texts.
_WARRANTY = {
    "mit": (
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,"
        " fitness for a particular purpose and noninfringement. In no event shall the <<var;words=1-8>> be liable for any claim, damages or other liability,"
        " whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
    ),
    "bsd": (
        "<<optional>>3. Neither the name of <<var;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission.<</optional>> This software is provided by the <<var;words=1-8>> \"as is\" and any express or implied warranties,"
        " including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the"
        " <<var;words=1-8>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of"
        " substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract,"
        " strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
    ),
    "isc": (
        "The software is provided \"as is\" and <<var;words=1-8>> disclaims all warranties with regard to this software including all implied warranties of"
        " merchantability and fitness. In no event shall <<var;words=1-8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever"
        " resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use"
        " or performance of this software."
    ),
}
TEMPLATES |= {f"full-{k}": f"{TEMPLATES[f'text-{k}']} {v}" for k, v in _WARRANTY.items()}

_MARK = re.compile(r"<<(/?optional|var;words=(\d+)-(\d+))>>")


class Automaton:
    """Set-of-states automaton over words; states are bits of an integer."""

    def __init__(self, template: str):
        self.on: dict[bytes, int] = defaultdict(int)  # by word, the states that it may leave
        self.any = 0  # states that any word may leave
        skips: list[tuple[int, int]] = []
        n, at, opened = 0, 0, []
        for mark in [*_MARK.finditer(template), None]:
            for w in words(template[at : mark.start() if mark else len(template)]):
                self.on[w] |= 1 << n
                n += 1
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "optional":
                opened.append(n)
            elif mark[1] == "/optional":
                skips.append((opened.pop(), n))
            else:
                least, most = int(mark[2]), int(mark[3])
                for k in range(most):
                    if k >= least:
                        skips.append((n, n + most - k))
                    self.any |= 1 << n
                    n += 1
        if opened:
            raise ValueError("an optional region is not closed")
        self.skips, self.end = sorted(skips), n
        self.start = self._closed(1)
        self.firsts = [w for w, bits in self.on.items() if bits & self.start]
        if self.start & self.any or not self.firsts:
            raise ValueError("a template must begin with a mandatory word")

    def _closed(self, states: int) -> int:
        for a, b in self.skips:
            if states >> a & 1:
                states |= 1 << b
        return states

    def accepts_at(self, text: list[bytes], at: int) -> bool:
        states, final, on = self.start, 1 << self.end, self.on
        n = len(text)
        while not states & final:
            if at == n:
                return False
            states = (states & (on.get(text[at], 0) | self.any)) << 1
            if not states:
                return False
            states = self._closed(states)
            at += 1
        return True


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        templates = TEMPLATES if templates is None else templates
        self.starts: dict[bytes, list[tuple[Automaton, str, bool]]] = defaultdict(list)
        for phrase, label in BASE.items():
            self._add(phrase, label, True)
        for label, template in templates.items():
            self._add(template, label, False)
        self.triggers = list(self.starts)

    def _add(self, template: str, label: str, base: bool) -> None:
        automaton = Automaton(template)
        for w in automaton.firsts:
            self.starts[w].append((automaton, label, base))

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], set[str]]:
        """Number of words, starts of the base phrases, base labels, and the templates' labels."""
        data = text.encode().translate(WORD_TABLE) if text else b""
        w = data.split()
        places: list[int] = []
        base: set[str] = set()
        more: set[str] = set()
        if any(t in data for t in self.triggers):
            starts = self.starts
            for i, word in enumerate(w):
                if word in starts:
                    for automaton, label, is_base in starts[word]:
                        if automaton.accepts_at(w, i):
                            if is_base:
                                places.append(i)
                                base.add(label)
                            else:
                                more.add(label)
        return len(w), places, base, more


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Base phrases and accepted templates of each text.

    score is 1 where a template is accepted, else 0.5 where a base phrase stands, else 0. Null
    and empty texts have no words: counts 0, places null, labels empty. A row for each row;
    texts of any length are scanned whole. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                n, places, base, more = scanner.scan(text)
                score = 1.0 if more else 0.5 if base else 0.0
                found = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score)
                for out, v in zip(rows, found, strict=True):
                    out.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return id_text(docs).mapInArrow(run, SCHEMA)


def template_regex(template: str) -> str:
    """The template over words that each have a space on both sides, as a regular expression; for checks."""
    out, at = [], 0
    for mark in [*_MARK.finditer(template), None]:
        out += [f" {w.decode()} " for w in words(template[at : mark.start() if mark else len(template)])]
        if mark is None:
            break
        at = mark.end()
        out.append("(?:" if mark[1] == "optional" else ")?" if mark[1] == "/optional" else f"(?: [^ ]+ ){{{mark[2]},{mark[3]}}}")
    return "".join(out)
