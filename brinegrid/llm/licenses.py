"""License scans of whole texts: phrases, and templates with optional and replaceable regions compiled into token automata.

A template is written in the markup of license lists: <<beginOptional>> ... <<endOptional>> may be left out, and
<<var;name="...";original="...";match="...">> may be replaced. All other wording is mandatory and must stand in the text word
for word. `match` is a choice of wordings, (one|another wording), or .{a,b}: a to b words of any kind. Every template
becomes positions of one automaton over words (each word of the markup is a position, and a position knows those that may
follow it), whose sets of active positions are found as texts need them and kept. A text is scanned for pairs of words with
which some template begins; from these places the automaton runs, and a template is accepted where its last mandatory wording
has been met. Runs end after the longest template's length, so the work is linear in the text.

Words are compared by 64-bit hashes. The score is 1 if a template is accepted, 0.5 if only a phrase is there, and otherwise
half the share of a template's mandatory words that a run met in order, where that is a half at least.

Defined cases: null and empty texts have no words, no places and score 0; a phrase counts at each place, overlaps included; of
a template's accepted places that overlap the first is kept, at its longest; rows are independent, so ties and repeated rows
need no rule; a text of any length is one row; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, Words, slices

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licenses' own wording, in markup.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";original="this software and associated documentation files (the Software)";match="(this software and associated documentation files the software|this software and associated documentation files|this software)">>,
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="the authors or copyright holders";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>"""
ISC = """Permission to use, copy, modify, <<var;name="and";original="and/or";match="(and or|and)">> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";original="the copyright holder";match=".{1,20}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;name="what";original="file";match="(file|software|work|project)">> except in compliance with the License. You may obtain a copy of the License at
<<var;name="where";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,12}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This <<var;name="what";original="program";match="(program|library|file|software)">> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>,
either<<endOptional>> version {version} of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>"""
GRANT = """<<beginOptional>>this <<var;name="what";original="work";match="(work|software|project|program|code|file|document|text|article)">> is<<endOptional>> <<var;name="how";original="licensed";match="(licensed|released|distributed|published|available|made available|provided)">> under
<<beginOptional>>the terms of<<endOptional>> <<beginOptional>><<var;name="article";original="the";match="(the|a|an)">><<endOptional>> """


def templates() -> list[tuple[str, str]]:
    """(label, markup) of the shipped templates."""
    found = [("text:mit", MIT), ("text:isc", ISC), ("text:bsd-2-clause", BSD), ("text:bsd-3-clause", f"{BSD} {BSD_THIRD}"), ("text:apache-2.0", APACHE)]
    found += [(f"text:gpl-{v}.0", GPL.format(version=v)) for v in (2, 3)]
    found += [("notice:mit", GRANT + "MIT License"), ("notice:apache-2.0", GRANT + "Apache License<<beginOptional>>, Version<<endOptional>> 2.0")]
    for name, wording in (("gpl", "GNU General Public License"), ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License")):
        found += [(f"notice:{name}-{v}.0", f"{GRANT}{wording}<<beginOptional>>,<<endOptional>> <<beginOptional>>version<<endOptional>> {v}<<beginOptional>>.0<<endOptional>>") for v in (2, 3)]
    for kind in ("by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd"):
        found += [(f"notice:cc-{kind}-{v}", f"{GRANT}CC <<beginOptional>>License<<endOptional>> {kind} {v}") for v in ("2.0", "3.0", "4.0")]
    return found


#: A word's bytes are digits, small letters and all bytes beyond ASCII, after A-Z are lower-cased.
PARTS = np.ones(256, bool)
PARTS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MARK = re.compile(r"<<(.*?)>>", re.S)
#: Steps of the automaton that a Python worker keeps; beyond that it starts a new table.
KEPT = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Template:
    """Markup as nested parts: a word, None for any word, a list of parts in order, ("optional", part) or ("choice", parts)."""

    def __init__(self, markup: str):
        open_lists: list[list] = [[]]
        at = 0
        for mark in MARK.finditer(markup):
            open_lists[-1] += words_of(markup[at : mark.start()])
            at = mark.end()
            kind, _, rest = mark[1].partition(";")
            if kind == "beginOptional":
                open_lists.append([])
            elif kind == "endOptional" and len(open_lists) > 1:
                inner = open_lists.pop()
                open_lists[-1] += [("optional", inner)] if inner else []
            elif kind == "var":
                open_lists[-1].append(self._region(rest))
            else:
                raise ValueError(f"the template has a mark that is not known: {mark[0]}")
        if len(open_lists) > 1:
            raise ValueError("the template has an optional region without end")
        self.parts = open_lists[0] + words_of(markup[at:])

    @staticmethod
    def _region(rest: str):
        match = re.search(r'match="(.*?)"', rest, re.S)
        if match and (count := re.fullmatch(r"\.\{(\d+),(\d+)\}", match[1])):
            least, most = int(count[1]), int(count[2])
            region = []
            for _ in range(most - least):
                region = [("optional", [None, *region])]
            return [None] * least + region
        if match and match[1].startswith("(") and match[1].endswith(")"):
            return ("choice", [words_of(x) for x in match[1][1:-1].split("|")])
        raise ValueError(f"a region that may be replaced needs a match of .{{a,b}} or (one|another): {rest}")


class Automaton:
    """All templates as one automaton: a state is a set of positions, as the bits of an integer."""

    def __init__(self, given: list[tuple[str, str]]):
        self.labels = [label for label, _ in given]
        self.words: list[str | None] = []
        self.follow: list[int] = []
        self.met: list[int] = []
        self.of: list[int] = []
        self.needs, self.begin, self.end = [], 0, 0
        for self._template, (_, markup) in enumerate(given):
            self._needed = 0
            may_be_empty, first, last = self._build(Template(markup).parts, True)
            if may_be_empty or any(self.words[p] is None for p in self._bits(first)):
                raise ValueError("a template must begin with a word")
            self.begin |= first
            self.end |= last
            self.needs.append(max(1, self._needed))
        self.known = sorted({w for w in self.words if w is not None})
        number = {w: k for k, w in enumerate(self.known)}
        anything = sum(1 << p for p, w in enumerate(self.words) if w is None)
        self.allow = [anything] * (len(self.known) + 1)  # the last, also at -1, is every other word's
        for p, w in enumerate(self.words):
            if w is not None:
                self.allow[number[w]] |= 1 << p
        self.pairs = np.zeros((len(self.known) + 1,) * 2, bool)
        for p in self._bits(self.begin):
            row = self.pairs[number[self.words[p]]]
            row[:] |= bool(self.end >> p & 1)
            for q in self._bits(self.follow[p]):
                row[slice(None) if self.words[q] is None else number[self.words[q]]] = True
        self.steps: dict[tuple[int, int], int] = {}
        self.about: dict[int, tuple[tuple[int, ...], float]] = {}

    @staticmethod
    def _bits(mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def _build(self, part, needed: bool) -> tuple[bool, int, int]:
        """(may be empty, first positions, last positions) of a part; needed: whether its words are mandatory."""
        if isinstance(part, list):
            empty, first, last = True, 0, 0
            for inner in part:
                inner_empty, inner_first, inner_last = self._build(inner, needed)
                for p in self._bits(last):
                    self.follow[p] |= inner_first
                first |= inner_first if empty else 0
                last = inner_last | (last if inner_empty else 0)
                empty &= inner_empty
            return empty, first, last
        if isinstance(part, tuple):
            kind, inner = part
            if kind == "optional":
                return (True, *self._build(inner, False)[1:])
            each = [self._build(x, False) for x in inner]
            return any(x[0] for x in each), sum(x[1] for x in each), sum(x[2] for x in each)
        self._needed += needed and part is not None
        self.words.append(part)
        self.follow.append(0)
        self.met.append(self._needed)
        self.of.append(self._template)
        return False, 1 << len(self.words) - 1, 1 << len(self.words) - 1

    def step(self, state: int, word: int) -> int:
        key = (state, word)
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) > KEPT:
                self.steps.clear()
                self.about.clear()
            reached = 0
            for p in self._bits(state):
                reached |= self.follow[p]
            found = self.steps[key] = reached & self.allow[word]
        return found

    def said(self, state: int) -> tuple[tuple[int, ...], float]:
        """The templates accepted in a state, and the largest share of a template's mandatory words met."""
        found = self.about.get(state)
        if found is None:
            accepted = tuple(sorted({self.of[p] for p in self._bits(state & self.end)}))
            found = self.about[state] = accepted, max(self.met[p] / self.needs[self.of[p]] for p in self._bits(state))
        return found

    def run(self, words: list[int], start: int, stop: int) -> tuple[dict[int, int], float]:
        """The templates accepted from a place, with the longest end of each, and the share met."""
        state = self.begin & self.allow[words[start]]
        ends, share, at = {}, 0.0, start
        while state:
            at += 1
            accepted, met = self.said(state)
            share = max(share, met)
            for t in accepted:
                ends[t] = at
            if at == stop:
                break
            state = self.step(state, words[at])
        return ends, share


class Scanner:
    """Finds the phrases and the templates in batches of texts."""

    def __init__(self, phrases: dict[str, str], given: list[tuple[str, str]]):
        self.automaton = Automaton(given)
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.known = sorted({*self.automaton.known, *(w for ws, _ in self.phrases for w in ws)})
        hashes = np.concatenate([Words(Texts(pa.array([w])), parts=PARTS).hashes for w in self.known])
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        self.head = np.zeros(1 << 16, bool)
        self.head[(hashes >> np.uint64(48)).astype(np.int64)] = True
        own = {w: k for k, w in enumerate(self.automaton.known)}
        self.number = {w: k for k, w in enumerate(self.known)}
        self.own = np.array([own.get(w, len(own)) for w in self.known] + [len(own)])

    def numbered(self, words: Words) -> np.ndarray:
        """The number of each word of a batch, -1 where no phrase or template has it."""
        maybe = np.flatnonzero(self.head[(words.hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, words.hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[place] == words.hashes[maybe]
        out = np.full(len(words.hashes), -1, np.int32)
        out[maybe[hit]] = self.order[place[hit]]
        return out

    def scan(self, column: pa.Array) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base labels, matches, score) of each text."""
        words = Words(Texts(column), lower=True, parts=PARTS)
        bounds, number = words.offsets, self.numbered(words)
        n, total = np.diff(bounds), len(number)
        rows: list[list] = [[int(x), 0, None, None, set(), [], 0.0] for x in n]
        for phrase, label in self.phrases:
            k = len(phrase)
            if total < k:
                continue
            at = np.ones(total - k + 1, bool)
            for j, w in enumerate(phrase):
                at &= number[j : total - k + 1 + j] == self.number[w]
            at = np.flatnonzero(at)
            at = at[words.doc[at] == words.doc[at + k - 1]]
            doc, first, count = np.unique(words.doc[at], return_index=True, return_counts=True)
            for d, f, c in zip(doc.tolist(), first.tolist(), count.tolist()):
                low, high, row = int(at[f] - bounds[d]), int(at[f + c - 1] - bounds[d]), rows[d]
                row[1] += c
                row[2] = low if row[2] is None else min(row[2], low)
                row[3] = high if row[3] is None else max(row[3], high)
                row[4].add(label)
        own = self.own[number]
        starts = np.flatnonzero(self.automaton.pairs[own, np.append(own[1:], len(self.automaton.known))]) if total else []
        upto = -1
        for start in starts.tolist() if total else []:
            d = int(words.doc[start])
            if d != upto:
                upto, held, lo, hi = d, {}, int(bounds[d]), int(bounds[d + 1])
                sequence = own[lo:hi].tolist()
            ends, share = self.automaton.run(sequence, start - lo, hi - lo)
            for t, end in ends.items():
                if start - lo >= held.get(t, 0):
                    rows[d][5].append((self.automaton.labels[t], start - lo, end))
                    held[t] = end
            rows[d][6] = max(rows[d][6], 1.0 if ends else share / 2 if share >= 0.5 else 0.0)
        return [(*r[:4], sorted(r[4]), r[5], max(r[6], 0.5 if r[1] else 0.0)) for r in rows]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, given: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches, score) of every whole text.

    matches: label, start and end of each accepted template, in words. Both kinds of labels are distinct and sorted.
    """
    phrases, given = PHRASES if phrases is None else phrases, templates() if given is None else given
    Automaton(given)  # refuses wrong markup before the job
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.list_(pa.string()), match, pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, given)
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = zip(*scanner.scan(batch.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, matches array<struct<label: string, start: bigint, end: bigint>>, score double"
    )
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    return made.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), "matches", "score")
