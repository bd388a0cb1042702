"""License scans by templates with markup: optional and replaceable regions are compiled into token automata.

A template is the license's wording with two kinds of markup: ``[[ … ]]`` encloses wording that may be absent (such
regions may be nested), ``{{n}}`` stands for up to n arbitrary words. A text is accepted where all mandatory words stand
in order and unchanged; white space, punctuation and case don't count. States are sets of template places, so a text is
read once from each place where a template can begin, and left as soon as no place remains.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.batches import portions

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wordings of public license notices (fixed values); keys are the labels of accepted texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 [[(the License)]]",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at [[{{8}}]] Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        [[3]] Neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "cc-by": "Licensed under [[a|the]] [[Creative Commons Attribution]] [[CC BY]] 4.0 [[International]] [[License]]",
    "cc-by-nc": "Licensed under [[a|the]] [[Creative Commons Attribution-NonCommercial]] [[CC BY-NC]] 4.0 [[International]] [[License]]",
    "cc-by-sa": "Licensed under [[a|the]] [[Creative Commons Attribution-ShareAlike]] [[CC BY-SA]] 4.0 [[International]] [[License]]",
    "gpl-notice": "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] [[, version {{1}}]]",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version {{1}} of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-notice": "[[Released|Licensed]] [[Distributed]] under the [[terms of the]] MIT License",
    "mit-text": """[[Copyright {{12}}]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software.""",
}
#: Creative Commons notices need their short or their long name; a template alone can't say so.
NEEDS = {"cc-by": ((b"by",), (b"attribution",)), "cc-by-nc": ((b"nc",), (b"noncommercial",)), "cc-by-sa": ((b"sa",), (b"sharealike",))}
SCHEMA = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
          "matches array<struct<label: string, start: bigint, end: bigint>>")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclass
class Automaton:
    """States are numbered template places; ``edges`` read a word, ``skips`` read none, ``gaps`` read any word."""

    edges: dict[int, list[tuple[bytes, int]]] = field(default_factory=dict)
    skips: dict[int, list[int]] = field(default_factory=dict)
    gaps: dict[int, int] = field(default_factory=dict)
    end: int = 0

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        todo, out = list(states), set()
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skips.get(s, ())
        return frozenset(out)

    def __post_init__(self):
        self.memo: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        reads = any(word == w for s in states for w, _ in self.edges.get(s, ()))
        key = (states, word if reads else b"")
        if key not in self.memo:
            to = [t for s in states for w, t in self.edges.get(s, ()) if reads and w == word]
            self.memo[key] = self.closed(to + [self.gaps[s] for s in states if s in self.gaps])
        return self.memo[key]

    def first_words(self) -> set[bytes]:
        return {w for s in self.closed([0]) for w, _ in self.edges.get(s, ())}

    def needed_word(self) -> bytes | None:
        """The longest word that every accepted run of words has."""
        for word in sorted({w for edges in self.edges.values() for w, _ in edges}, key=lambda w: (-len(w), w)):
            todo, seen = [0], set()
            while todo:
                s = todo.pop()
                if s not in seen:
                    seen.add(s)
                    todo += [t for w, t in self.edges.get(s, ()) if w != word] + self.skips.get(s, []) + [self.gaps[t] for t in (s,) if t in self.gaps]
            if self.end not in seen:
                return word
        return None

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words that begins at ``at``."""
        states, found, i = self.closed([0]), None, at
        while states:
            if self.end in states:
                found = i
            if i == len(words):
                break
            states, i = self.step(states, words[i]), i + 1
        return found


def compile_template(text: str) -> Automaton:
    """Automaton of one template. ``a|b`` between spaces is one word or the other."""
    auto, at, opened = Automaton(), 0, []

    def new() -> int:
        auto.end += 1
        return auto.end

    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", text):
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            to = new()
            auto.skips.setdefault(at, []).append(to)
            auto.skips.setdefault(opened.pop(), []).append(to)
            at = to
        elif token.startswith("{{"):
            to, places = new(), [at]
            for _ in range(int(token[2:-2])):
                places.append(new())
                auto.gaps[places[-2]] = places[-1]
            for p in places:
                auto.skips.setdefault(p, []).append(to)
            at = to
        elif "|" in token:
            to = new()
            auto.edges.setdefault(at, []).extend((w, to) for t in token.split("|") for w in words_of(t))
            at = to
        else:
            for w in words_of(token):
                to = new()
                auto.edges.setdefault(at, []).append((w, to))
                at = to
    # Places are numbered as they are made; the last one made need not be the last of the template.
    if at != auto.end:
        last = new()
        auto.skips.setdefault(at, []).append(last)
    return auto


class Scanner:
    """Looks for phrases and templates in one text after another."""

    def __init__(self, templates: dict[str, str], phrases: Iterable[tuple[str, str]]):
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases]
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.begins: dict[bytes, list[str]] = {}
        for label, a in self.automata.items():
            for w in a.first_words():
                self.begins.setdefault(w, []).append(label)
        # Templates and phrases can only stand where a word that each of them needs occurs; one that needs none can stand anywhere.
        needed = {max(p, key=len) for p, _ in self.phrases} | {a.needed_word() or b"" for a in self.automata.values()}
        self.needed = re.compile(b"" if b"" in needed else b"|".join(sorted(needed)))
        self.is_word = np.zeros(256, bool)
        self.is_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def count(self, data: bytes) -> int:
        inside = self.is_word[np.frombuffer(data, np.uint8)]
        return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(inside[0]) if len(data) else 0

    def scan(self, text: str) -> tuple:
        data = text.encode().lower()
        if not self.needed.search(data):
            return self.count(data), 0, None, None, [], []
        words = WORD.findall(data)
        places, labels, matches = [], set(), []
        last_words = {}
        for p, label in self.phrases:
            last_words.setdefault(p[0], []).append((p, label))
        for i, w in enumerate(words):
            for p, label in last_words.get(w, ()):
                if tuple(words[i:i + len(p)]) == p:
                    places.append(i)
                    labels.add(label)
            for label in self.begins.get(w, ()):
                end = self.automata[label].match(words, i)
                if end is not None and end > i and self._named(label, words[i:end]):
                    matches.append({"label": label, "start": i, "end": end})
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), matches

    @staticmethod
    def _named(label: str, words: list[bytes]) -> bool:
        return label not in NEEDS or any(all(w in words for w in alt) for alt in NEEDS[label])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, counts and places of the phrases, and the accepted templates with their places.

    Places are words from 0. Null and empty texts have no words, labels or matches. Repeated rows give repeated rows, an
    empty table none; ids may be null or equal, other columns are not read.
    """
    templates, phrases = templates or TEMPLATES, tuple(phrases)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(match)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "matches"]
        for batch in portions(batches):
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
