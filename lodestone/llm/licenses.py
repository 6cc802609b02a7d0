"""Licence scans: matching statistics against a suffix automaton of licence texts, chained into template spans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows

# Phrases that name a licence, and the wording of public licence notices (label, text).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("proprietary", "All rights reserved"),
]

# Shorter matches are no anchors, unless they are a whole template.
MIN_MATCH = 4
# Anchors of one span may leave out or insert this many words.
MAX_GAP = 16
# A span names its licence if it covers this share of the template's words.
MIN_COVER = 0.6

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton of several word sequences.

    A state stands for all words sequences that occur at the same places; ``places`` lists those places as (template,
    end), and ``phrases`` the whole phrases (length, index) that end wherever the state is reached.
    """

    def __init__(self, templates: Iterable[tuple[str, str]], phrases: Iterable[tuple[str, str]]):
        self.templates, self.phrase_labels = list(templates), [label for label, _ in phrases]
        texts = [words(t) for _, t in self.templates] + [words(t) for _, t in phrases]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.sizes = [len(t) for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for n, text in enumerate(texts):
            last = 0
            for end, word in enumerate(text, 1):
                last = self._extended(last, self.vocabulary[word])
                own.setdefault(last, []).append((n, end))
        by_length = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        reached: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in by_length:
            reached[s].extend(own.get(s, ()))
            if self.link[s] > 0:
                reached[self.link[s]].extend(reached[s])
        first = len(self.templates)
        self.places = [sorted(set(p for p in r if p[0] < first)) for r in reached]
        ending: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in reversed(by_length):
            whole = [(self.sizes[n], n - first) for n, e in own.get(s, ()) if n >= first and e == self.sizes[n]]
            ending[s] = whole + ending[max(self.link[s], 0)]
        self.phrases = ending

    def _extended(self, last: int, word: int) -> int:
        """The state of the sequence at ``last`` with ``word`` after it."""
        def twin(p: int, q: int) -> int:
            """``q``, or a copy of it that holds only its sequences up to one word longer than ``p``'s."""
            if self.length[q] == self.length[p] + 1:
                return q
            copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            return copy

        if word in self.next[last]:
            return twin(last, self.next[last][word])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = twin(p, self.next[p][word])
        return new

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases as (start, index), and the longest matches that no word extends as (start, length, state).

        At each word the automaton holds the longest suffix of the text so far that occurs in a template; only its
        state and length are kept while the text streams by.
        """
        found, anchors = [], []
        following, link, length, phrases = self.next, self.link, self.length, self.phrases
        state = size = 0
        for i, word in enumerate(map(self.vocabulary.get, text)):
            if word is None:
                if size:
                    anchors.append((i - size, size, state))
                    state = size = 0
                continue
            if word not in following[state]:
                if size:
                    anchors.append((i - size, size, state))
                while state and word not in following[state]:
                    state = link[state]
                    size = length[state]
            state = following[state].get(word, 0)
            size = size + 1 if state else 0
            for n, p in phrases[state]:
                if n <= size:
                    found.append((i - n + 1, p))
        if size:
            anchors.append((len(text) - size, size, state))
        return found, anchors

    def spans(self, anchors: list[tuple[int, int, int]]) -> list[dict]:
        """Anchors chained, per template, while both places rise and gaps stay within ``MAX_GAP``."""
        open_: dict[int, dict] = {}
        closed: list[dict] = []
        for start, size, state in anchors:
            best: dict[int, tuple[int, int]] = {}
            for n, end in self.places[state]:
                if size < min(MIN_MATCH, self.sizes[n]):
                    continue
                at, chain = end - size, open_.get(n)
                follows = chain and at >= chain["end"] - 1 and start - chain["last"] <= MAX_GAP and at - chain["end"] <= MAX_GAP
                cost = (0 if follows else 1, at)
                best[n] = min(best.get(n, cost), cost)
            for n, (fresh, at) in best.items():
                chain = open_.get(n)
                if fresh or not chain:
                    if chain:
                        closed.append(chain)
                    open_[n] = {"template": n, "first": start, "last": start + size, "begin": at, "end": at + size, "covered": size}
                else:
                    chain["covered"] += at + size - max(at, chain["end"])
                    chain["last"], chain["end"] = start + size, at + size
        out = []
        for c in closed + list(open_.values()):
            n = c["template"]
            out.append({"label": self.templates[n][0], "template": n, "first_word": c["first"], "last_word": c["last"] - 1,
                        "template_first": c["begin"], "template_last": c["end"] - 1, "cover": c["covered"] / self.sizes[n]})
        return sorted(out, key=lambda s: (s["first_word"], s["template"]))


def scan(df: DataFrame, key: str, text: str, templates: list[tuple[str, str]] = TEMPLATES,
         phrases: list[tuple[str, str]] = PHRASES, min_cover: float = MIN_COVER) -> DataFrame:
    """Licence phrases and template spans in each row's whole text.

    (key, n_words, places array<struct<label, start>>, spans array<struct<label, template, first_word, last_word,
    template_first, template_last, cover>>, labels array<string>, score). Places are all those of a phrase's
    consecutive words, words counted from 0; spans are listed if they cover ``min_cover`` of their template. ``labels``
    are the sorted labels of both, ``score`` the largest cover of any span (1 with a whole phrase, 0 with none). A null
    or empty text has no words, places or spans. Rows are kept apart; other columns are not read. The automaton is
    built once from the few templates and travels with the task; texts stream through it where they are read.
    """
    machine = Automaton(templates, phrases)

    def run(items: Iterator[dict]) -> Iterator[dict]:
        for r in items:
            seen = words(r["text"])
            found, anchors = machine.matches(seen)
            all_spans = machine.spans(anchors)
            spans = [s for s in all_spans if s["cover"] >= min_cover]
            places = [{"label": machine.phrase_labels[p], "start": i} for i, p in found]
            yield {
                "key": r["key"], "n_words": len(seen), "places": places, "spans": spans,
                "labels": sorted({x["label"] for x in places + spans}),
                "score": 1.0 if places else max((s["cover"] for s in all_spans), default=0.0),
            }

    return map_rows(
        df.select(F.col(key).alias("key"), F.col(text).alias("text")), run,
        "key bigint, n_words bigint, places array<struct<label: string, start: bigint>>, spans array<struct<label: "
        "string, template: int, first_word: bigint, last_word: bigint, template_first: int, template_last: int, cover: "
        "double>>, labels array<string>, score double",
    )
