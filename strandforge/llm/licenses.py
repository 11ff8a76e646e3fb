"""License scans: template markup compiled to token automata.

A template is license wording with two kinds of region: ``<<beginOptional>> ...
<<endOptional>>`` may be there or not, and ``<<var;name="holder";words="0,12">>`` stands
for any words, so many at least and at most. All other wording is mandatory. A template is
compiled to an automaton whose states are places in the wording, held as bits of one
integer: reading a word keeps the states that take it and moves them on, optional regions
add states without reading. It accepts where every mandatory word matched, in order.

Texts are reduced to words first, as the wording is: A-Z in lower case, runs of letters
and digits of any script. A template is tried where the longest run of its mandatory words
occurs, which every accepted text holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

#: Phrases that count wherever they stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licenses and notices, with optional and replaceable regions marked.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";words="1,12">> and associated documentation files
 <<beginOptional>>(the "Software")<<endOptional>>, to deal in <<var;name="what";words="1,4">> without restriction, including without limitation the rights to use, copy, modify, merge,
 publish, distribute, sublicense, and/or sell copies of <<var;name="what";words="1,4">>, and to permit persons to whom <<var;name="what";words="1,4">> is furnished to do so,
 subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
 substantial portions of <<var;name="what";words="1,4">>.""",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
 copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
 other materials provided with the distribution.""",
    "bsd-3-clause-text": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
 materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";words="1,16">> may be used to endorse or promote products derived from this
 software without specific prior written permission.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License<<endOptional>>""",
    "apache-2.0-terms": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
 KIND, either express or implied.""",
    "mit-notice": """<<beginOptional>><<var;name="subject";words="1,4">> is<<endOptional>> <<beginOptional>>also<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "gpl-notice": """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version <<var;name="version";words="1,1">>""",
    "gpl-redistribution": """you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> General Public License as published by the Free Software
 Foundation<<beginOptional>>; either<<endOptional>> version <<var;name="version";words="1,2">> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>""",
    "gpl-warranty": """<<var;name="program";words="0,6">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
 A PARTICULAR PURPOSE.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "zlib-text": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
 restrictions""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.""",
    "cc-by-nc-notice": """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<beginOptional>>license<<endOptional>> <<var;name="major";words="1,1">> <<var;name="minor";words="1,1">>""",
    "cc-by-notice": """licensed under a Creative Commons Attribution <<var;name="more";words="0,6">> License""",
    "spdx-tag": """SPDX-License-Identifier: <<var;name="id";words="1,8">>""",
}

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_MARK = re.compile(r'<<(?:(beginOptional)|(endOptional)|var;name="[^"]*";words="([0-9]+),([0-9]+)")>>')


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def parsed(markup: str) -> list:
    """Words, ("optional", parts) and ("any", least, most), in order."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += words_of(markup[at : m.start()])
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            parts = stack.pop()
            stack[-1].append(("optional", parts))
        else:
            least, most = int(m[3]), int(m[4])
            if least > most:
                raise ValueError("a replaceable region has fewer words at most than at least")
            stack[-1].append(("any", least, most))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    if "<<" in _MARK.sub("", markup):
        raise ValueError("unknown markup")
    return stack[0] + words_of(markup[at:])


class Automaton:
    """A template as places 0 to ``end``; bit p of a state set: the wording up to p is read."""

    def __init__(self, label: str, markup: str) -> None:
        self.label, self.takes, self.any, self.skips, self.end = label, {}, 0, [], 0
        self._run: list[str] = []
        self._runs: list[list[str]] = [self._run]
        self.mandatory = 0
        self._add(parsed(markup), True)
        self.skips.sort()
        #: The longest run of mandatory words, in spaces.
        self.anchor = f" {' '.join(max(self._runs, key=len))} "
        if not self.mandatory:
            raise ValueError("no mandatory wording")

    def _break(self) -> None:
        self._run = []
        self._runs.append(self._run)

    def _add(self, parts: list, mandatory: bool) -> None:
        for x in parts:
            if isinstance(x, str):
                self.takes[x] = self.takes.get(x, 0) | 1 << self.end
                self.end += 1
                if mandatory:
                    self.mandatory += 1
                    self._run.append(x)
                continue
            self._break()
            if x[0] == "optional":
                start = self.end
                self._add(x[1], False)
                self.skips.append((start, 1 << start, 1 << self.end))
            else:
                _, least, most = x
                first = self.end + least
                for _ in range(most):
                    self.any |= 1 << self.end
                    self.end += 1
                if most > least:
                    self.skips.append((first, (1 << self.end) - (1 << first), 1 << self.end))
            self._break()

    def closed(self, states: int) -> int:
        """With the places behind optional regions that may be left out."""
        for _, inside, behind in self.skips:
            if states & inside:
                states |= behind
        return states

    @cached_property
    def begin(self) -> int:
        return self.closed(1)

    def step(self, states: int, word: str) -> int:
        return self.closed((states & (self.takes.get(word, 0) | self.any)) << 1)

    def match(self, words: list[str], start: int) -> int | None:
        """Where the longest match that begins at ``start`` ends (exclusive)."""
        states, found, accept = self.begin, None, 1 << self.end
        for i in range(start, len(words)):
            if not states:
                break
            states = self.step(states, words[i])
            if states & accept:
                found = i + 1
        return found

    def matches(self, words: list[str], joined: str) -> list[tuple[int, int]]:
        """Matches from left to right, none within another's words. ``joined``: the words, in spaces."""
        if self.anchor not in joined:
            return []
        out, at = [], 0
        while at < len(words):
            if self.begin & (self.takes.get(words[at], 0) | self.any) and (end := self.match(words, at)) is not None:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


def automata(templates: dict[str, str] | None = None) -> list[Automaton]:
    return [Automaton(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]


def places(phrase: str, joined: str) -> list[int]:
    """Numbers of the words at which the phrase's words stand consecutively."""
    out, at, seen, n = [], joined.find(f" {phrase} "), 0, 0
    while at >= 0:
        n += joined.count(" ", seen, at)
        seen = at
        out.append(n)
        at = joined.find(f" {phrase} ", at + 1)
    return out


def surety(mandatory: int) -> float:
    """In [0, 1): rises with the number of words that had to match."""
    return mandatory / (mandatory + 8)


def scanned(text: str, machines: list[Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]], float]:
    """Number of words, (place, label) of phrases, (label, start, end) of templates, and the surety of the longest wording found."""
    words = words_of(text)
    joined = f" {' '.join(words)} "
    base = sorted((p, label) for phrase, label in PHRASES.items() for p in places(phrase, joined))
    score = max((surety(len(phrase.split())) for phrase in PHRASES if f" {phrase} " in joined), default=0.0)
    spans = []
    for m in machines:
        if got := m.matches(words, joined):
            spans += [(m.label, a, z) for a, z in got]
            score = max(score, surety(m.mandatory))
    return len(words), base, sorted(spans, key=lambda x: (x[1], x[2], x[0])), score


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (``label:start:end``, words from 0) of the templates.

    Null and empty texts have no words, no places (null first and last word), no labels and
    score 0. Texts are read whole, whatever their length; repeated rows and null ids are
    rows like others; of several matches the surest wording gives the score; an empty table
    gives an empty one; other columns are not looked at, whatever their names.
    """
    ship(docs.sparkSession)
    kinds = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", T.StringType())))])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(templates)
        for b in batches:
            rows = []
            for t in b.column(1):
                n, base, spans, score = scanned(t.as_py() or "", machines)
                found = {x for _, x in base}
                rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(found)), ",".join(sorted(found | {x for x, _, _ in spans})), score, ",".join(f"{x}:{a}:{z}" for x, a, z in spans)))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], kinds.names)

    return docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string")).mapInArrow(run, kinds)
