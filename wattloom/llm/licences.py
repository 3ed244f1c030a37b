"""Licence scans with a generalised suffix automaton over words.

The automaton holds every run of words of every template. A text is streamed through it; at each word
it knows the longest run ending there that some template holds (matching statistics). Long matches
are chained, in order both in the text and in a template, into the spans that the template covers.

Words outside the templates' vocabulary reset the state, so only runs of vocabulary words are streamed,
all runs of a batch side by side.
"""

from __future__ import annotations

import bisect
import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattloom.llm import words
from wattloom.llm.common import per_batch

#: Phrases that alone give a label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence notices, as (label, text).
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""),
)

#: Words of a match that may be chained, words between chained matches, share of a template that makes a label.
MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.6
#: Words covered that one word of the text skipped inside a span takes away.
SKIP_COST = 0.25
#: Share that a bare phrase counts as in the score.
PHRASE_SHARE = 0.5


class Automaton(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    step: np.ndarray  # state, word -> state, failures resolved
    cap: np.ndarray  # state, word -> longest match that survives the step
    phrase: np.ndarray  # state, phrase -> whether the phrase ends here
    whole: np.ndarray  # state, template -> whether the whole template ends here
    phrase_len: np.ndarray
    phrase_label: list
    ends: list  # state -> (template, last word) pairs
    template_len: list
    template_label: list


def _tokens(text: str) -> np.ndarray:
    return next((w.hash for _, _, _, w in words.runs(pa.array([text]), words.ALNUM)), np.zeros(0, np.uint64))


@functools.lru_cache(maxsize=1)
def automaton() -> Automaton:
    texts = [_tokens(t) for _, t in TEMPLATES] + [_tokens(p) for p in PHRASES]
    vocabulary = np.unique(np.concatenate(texts))
    coded = [np.searchsorted(vocabulary, t).tolist() for t in texts]
    goes, link, length, ends = [{}], [-1], [0], [set()]

    def add(at: int, c: int) -> int:
        """The state of the run at ``at`` followed by ``c``, splitting classes where needed."""
        if c in goes[at]:
            to = goes[at][c]
            return to if length[to] == length[at] + 1 else split(at, c, to)
        goes.append({})
        length.append(length[at] + 1)
        link.append(0)
        ends.append(set())
        new, p = len(goes) - 1, at
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            to = goes[p][c]
            link[new] = to if length[to] == length[p] + 1 else split(p, c, to)
        return new

    def split(p: int, c: int, to: int) -> int:
        goes.append(dict(goes[to]))
        length.append(length[p] + 1)
        link.append(link[to])
        ends.append(set())
        twin = len(goes) - 1
        link[to] = twin
        while p >= 0 and goes[p].get(c) == to:
            goes[p][c] = twin
            p = link[p]
        return twin

    final = []
    for k, codes in enumerate(coded):
        at = 0
        for i, c in enumerate(codes):
            at = add(at, c)
            if k < len(TEMPLATES):
                ends[at].add((k, i))
        final.append(codes)
    order = sorted(range(1, len(goes)), key=lambda s: -length[s])
    for s in order:
        ends[link[s]] |= ends[s]
    step = np.zeros((len(goes), len(vocabulary)), np.int32)
    cap = np.full((len(goes), len(vocabulary)), -1, np.int32)
    for s in sorted(range(len(goes)), key=lambda s: length[s]):
        if s:
            step[s], cap[s] = step[link[s]], np.minimum(cap[link[s]], length[link[s]])
        for c, to in goes[s].items():
            step[s, c], cap[s, c] = to, 1 << 30
    phrases = coded[len(TEMPLATES) :]
    phrase = np.zeros((len(goes), len(phrases)), bool)
    for k, codes in enumerate(phrases):
        at = 0
        for c in codes:
            at = goes[at][c]
        phrase[at, k] = True
    whole = np.zeros((len(goes), len(TEMPLATES)), bool)
    for k, codes in enumerate(coded[: len(TEMPLATES)]):
        at = 0
        for c in codes:
            at = goes[at][c]
        whole[at, k] = True
    for s in reversed(order):  # from short to long: a longer run ends with what its link ends with
        phrase[s] |= phrase[link[s]]
        whole[s] |= whole[link[s]]
    return Automaton(
        vocabulary, step, cap, phrase, whole, np.array([len(p) for p in phrases]), list(PHRASES.values()),
        [sorted(e) for e in ends], [len(c) for c in coded[: len(TEMPLATES)]], [label for label, _ in TEMPLATES],
    )


def matching_statistics(w: words.Words, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """At each word the automaton's state and the length of the longest template run that ends there."""
    code = np.searchsorted(a.vocabulary, w.hash)
    code[code == len(a.vocabulary)] = 0
    known = a.vocabulary[code] == w.hash
    state, length = np.zeros(len(code), np.int32), np.zeros(len(code), np.int32)
    if not known.any():
        return state, length
    head = known.copy()
    head[1:] &= ~known[:-1]
    head[w.first[:-1][w.first[:-1] < len(code)]] |= known[w.first[:-1][w.first[:-1] < len(code)]]
    begin = np.flatnonzero(head)
    stop = np.append(np.flatnonzero(head)[1:], len(code))
    # a run ends where the next begins or at the first unknown word
    unknown = np.append(np.flatnonzero(~known), len(code))
    size = np.minimum(stop, unknown[np.searchsorted(unknown, begin)]) - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    s, m = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")
    for t in range(int(size[0])):
        n = int(live[t])
        at = begin[:n] + t
        c = code[at]
        m[:n] = np.minimum(m[:n], a.cap[s[:n], c]) + 1
        s[:n] = a.step[s[:n], c]
        state[at], length[at] = s[:n], m[:n]
    return state, length


def chain(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
    """Spans (first word, last word, covered words less what skipped ones cost) of one template from matches (text end, template end, length).

    Matches follow each other in both orders with gaps of at most ``MAX_GAP`` words; overlap counts once.
    """
    matches = sorted(set(matches))
    best: list[tuple[float, int]] = []  # covered, previous
    for i, (end, place, length) in enumerate(matches):
        own = (float(length), -1)
        # a match is no longer than its template, so these are few
        for j in range(bisect.bisect_left(matches, (end - length - MAX_GAP,)), i):
            e, p, _ = matches[j]
            gained = min(length, end - e, place - p)
            if gained > 0 and place - length - p <= MAX_GAP:
                total = best[j][0] + gained - SKIP_COST * (end - e - gained)
                if total > own[0]:
                    own = (total, j)
        best.append(own)
    spans, used = [], set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i][0], i)):
        at, path = i, []
        while at >= 0 and at not in used:
            path.append(at)
            at = best[at][1]
        if at < 0:
            spans.append((matches[path[-1]][0] - matches[path[-1]][2] + 1, matches[i][0], min(best[i][0], size)))
        used.update(path)
    return sorted(spans)


def settled(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """(label, first, last, share) of the spans (label, first, last, covered, template words) that hold.

    Neighbouring licences share most of their words: of two labels' spans that lie on each other by half
    of the shorter one or more, the one that covers more words stays, then the one with the larger share,
    however small it is. What stays and covers ``MIN_SHARE`` of its template holds.
    """
    kept: list[tuple[str, int, int, float, int]] = []
    near: dict[int, list] = {}  # stretch of 64 words -> spans kept there
    for one in sorted(spans, key=lambda s: (-s[3], -s[3] / s[4], s[0], s[1], s[2])):
        label, first, last = one[:3]
        shared = lambda o: 2 * (min(last, o[2]) - max(first, o[1]) + 1) >= min(last - first, o[2] - o[1]) + 1
        places = range(first // 64, last // 64 + 1)
        if not any(o[0] != label and shared(o) for at in places for o in near.get(at, ())):
            kept.append(one)
            for at in places:
                near.setdefault(at, []).append(one)
    return [(label, first, last, got / size) for label, first, last, got, size in kept if got >= MIN_SHARE * size]


def scan_texts(texts: pa.Array) -> dict:
    """Columns of :func:`scan` for a column of texts."""
    a = automaton()
    n = len(texts)
    out = {"n_words": np.zeros(n, np.int64), "n_base": np.zeros(n, np.int64), "first_word": [None] * n, "last_word": [None] * n}
    base, spans = [set() for _ in range(n)], [[] for _ in range(n)]
    for i, j, _, w in words.runs(texts, words.ALNUM):
        out["n_words"][i:j] = w.counts()
        state, length = matching_statistics(w, a)
        at, which = np.nonzero(a.phrase[state] & (length > 0)[:, None])
        start = at - a.phrase_len[which] + 1
        text = np.searchsorted(w.first, at, "right") - 1
        for t, s, k in zip((i + text).tolist(), (start - w.first[text]).tolist(), which.tolist()):
            out["n_base"][t] += 1
            out["first_word"][t] = s if out["first_word"][t] is None else min(s, out["first_word"][t])
            out["last_word"][t] = s if out["last_word"][t] is None else max(s, out["last_word"][t])
            base[t].add(a.phrase_label[k])
        last = length >= MIN_MATCH
        last[:-1] &= length[1:] <= length[:-1]
        found: dict = {}
        at = np.flatnonzero(last)
        text = np.searchsorted(w.first, at, "right") - 1
        for p, t in zip(at.tolist(), text.tolist()):
            for template, place in a.ends[state[p]]:
                found.setdefault((t, template), []).append((p - int(w.first[t]), place, int(length[p])))
        # a template that lies whole within a longer run of another one
        some = np.flatnonzero(a.whole.any(1)[state])
        at, which = np.nonzero(a.whole[state[some]] & (length[some, None] >= np.array(a.template_len)))
        at = some[at]
        text = np.searchsorted(w.first, at, "right") - 1
        for p, t, k in zip(at.tolist(), text.tolist(), which.tolist()):
            found.setdefault((t, k), []).append((p - int(w.first[t]), a.template_len[k] - 1, a.template_len[k]))
        for (t, template), matches in found.items():
            for first, end, got in chain(matches, a.template_len[template]):
                spans[i + t].append((a.template_label[template], first, end, got, a.template_len[template]))
    spans = [settled(own) for own in spans]
    out["base_labels"] = [",".join(sorted(b)) for b in base]
    out["labels"] = [",".join(sorted(b | {s[0] for s in own})) for b, own in zip(base, spans)]
    out["score"] = [max([s[3] for s in own] + [PHRASE_SHARE * bool(b)]) for b, own in zip(base, spans)]
    out["spans"] = [[f"{label}:{first}:{end + 1}" for label, first, end, _ in sorted(own, key=lambda s: (s[1], s[2], s[0]))] for own in spans]
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base phrases, labels, covered spans (`label:start:end`, words, end exclusive) and a score.

    The score is the largest covered share of a template, a bare phrase counting as ``PHRASE_SHARE``.
    Null and empty texts have no words, empty labels and score 0.
    """
    return per_batch(docs.select("doc_id", "text"), SCHEMA, lambda b: {"doc_id": b.column("doc_id")} | scan_texts(b.column("text")))
