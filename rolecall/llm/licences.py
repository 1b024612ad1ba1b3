"""License scans: exact set-similarity join of text blocks with license templates.

A block is a window of a template's length and a quarter, as words stand in the text: it crosses line ends, as long
notices are wrapped, and ends with the text. Its tokens are runs of digits, letters and everything beyond ASCII, A-Z
lower-cased. A block meets a template if it holds at least `numerator / denominator` of the template's distinct tokens.
Template tokens are ordered by their frequency in all texts, rarest first; if o tokens must be shared, one of the first
(size - o + 1) is, so only blocks with such a prefix token are looked at (prefix filter). Of these tokens the rarest
shared one decides: a place of the token of order i is left out unless o words around it have order i or later
(positional filter), and a run of template words of which no block holds o (length filter). Beside the templates,
phrases are found wherever their words stand consecutively.

Templates and phrases are a short hand-written list, so they travel with the code; frequencies are counted over all
texts, for template tokens only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ALNUM, Words, chunks, word_hashes

# Phrases and labels that results must agree with.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Usual notices of public licenses, short forms and whole ones.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
            "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
                 "of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                 "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
                 "limitations under the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
              "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
              "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
            "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
            "provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
              "obtain one at"),
)


@dataclass(frozen=True)
class LicenceSettings:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    numerator: int = 4
    denominator: int = 5


class Index:
    """Templates by token number, tokens numbered from the rarest on."""

    def __init__(self, settings: LicenceSettings, frequency: dict[int, int] | None = None):
        own = word_hashes([t for _, t in settings.templates], ALNUM)
        self.tokens = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        often = np.array([(frequency or {}).get(int(t.astype(np.int64)), 0) for t in self.tokens])
        rank = np.empty(len(self.tokens), np.int64)
        rank[np.lexsort((self.tokens, often))] = np.arange(len(self.tokens))
        self.rank = rank
        self.templates = []
        for (label, _), h in zip(settings.templates, own):
            ordered = np.sort(rank[np.searchsorted(self.tokens, np.unique(h))])
            need = -(-len(ordered) * settings.numerator // settings.denominator)
            if len(ordered):
                order = np.full(len(self.tokens) + 1, -1)  # of each token number in the template, -1: not in it
                order[ordered] = np.arange(len(ordered))
                self.templates.append((label, order, len(ordered), need, -(-len(h) * settings.denominator // settings.numerator)))
        self.phrases = [(label, h) for (_, label), h in zip(settings.phrases, word_hashes([p for p, _ in settings.phrases], ALNUM))]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each token; one beyond all for tokens of no template."""
        if not len(self.tokens):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[place] == hashes, self.rank[place], len(self.tokens))

    def windows(self, numbers: np.ndarray, row: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, containment) of each place where a window meets a template.

        Of a run of starts that meet the template, the first of the best is given.
        """
        out = []
        n = len(numbers)
        for label, order, size, need, width in self.templates:
            place = order[numbers]
            at = np.flatnonzero(place >= 0)
            if len(at) < need:
                continue
            own, rows = place[at], row[at]
            near = np.zeros(len(at), bool)  # beside a place that may be a window's rarest shared token
            for i in range(size - need + 1):
                later = np.cumsum(np.append(0, own >= i))
                spot = np.flatnonzero(own == i)
                low = np.maximum(np.searchsorted(at, at[spot] - width, side="right"), np.searchsorted(rows, rows[spot]))
                high = np.minimum(np.searchsorted(at, at[spot] + width), np.searchsorted(rows, rows[spot], side="right"))
                fits = later[high] - later[low] >= need
                cover = np.bincount(low[fits], minlength=len(at) + 1) - np.bincount(high[fits], minlength=len(at) + 1)
                near |= np.cumsum(cover)[:-1] > 0
            at = at[near]
            if len(at) < need:
                continue
            # `need` neighbouring words that no window holds together say nothing
            within = np.flatnonzero((at[need - 1 :] - at[: len(at) - need + 1] < width) & (row[at[need - 1 :]] == row[at[: len(at) - need + 1]]))
            cover = np.bincount(within, minlength=len(at) + 1) - np.bincount(within + need, minlength=len(at) + 1)
            close = np.cumsum(cover)[:-1] > 0
            at = at[close]
            if not len(at):
                continue
            sort = np.lexsort((at, numbers[at]))
            before = np.full(len(at), -1)
            same = numbers[at[sort[1:]]] == numbers[at[sort[:-1]]]
            before[sort[1:][same]] = at[sort[:-1][same]]
            # a word counts in each window that holds it but not the same word before it
            begin = np.maximum(np.maximum(at - width, before) + 1, np.searchsorted(row, row[at]))
            edge, spot = np.unique(np.concatenate([begin, at + 1]), return_inverse=True)
            count = np.cumsum(np.bincount(spot[: len(at)], minlength=len(edge)) - np.bincount(spot[len(at) :], minlength=len(edge)))
            good = np.flatnonzero(count >= need)
            for part in np.split(good, np.flatnonzero((np.diff(good) > 1) | (np.diff(row[edge[good]]) > 0)) + 1) if len(good) else ():
                best = part[np.argmax(count[part])]
                a = int(edge[best])
                out.append((a, int(min(a + width, np.searchsorted(row, row[a], side="right"), n)), label, float(count[best] / size)))
        return out


def _frequencies(settings: LicenceSettings):
    def run(batches):
        index = Index(settings)
        total = np.zeros(len(index.tokens) + 1, np.int64)
        back = np.empty(len(index.tokens), np.int64)
        back[index.rank] = np.arange(len(index.tokens))
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                total += np.bincount(index.numbers(Words(data, offsets, ALNUM).hash), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(index.tokens[back].view(np.int64)), pa.array(total[:-1])], ["token", "count"])
    return run


_FOUND = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64()), ("phrase", pa.bool_())])


def _scanned(settings: LicenceSettings, frequency: dict[int, int], names: list[str]):
    def run(batches):
        index = Index(settings, frequency)
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, ALNUM)
                found: list[list[dict]] = [[] for _ in range(last - first)]
                n, base = len(w.hash), w.first
                for label, phrase in index.phrases:
                    k = len(phrase)
                    if n < k:
                        continue
                    hit = w.row[: n - k + 1] == w.row[k - 1 :]
                    for j in range(k):
                        hit &= w.hash[j : n - k + 1 + j] == phrase[j]
                    for i in np.flatnonzero(hit):
                        at = int(i - base[w.row[i]])
                        found[w.row[i]].append({"label": label, "start": at, "end": at + k, "containment": 1.0, "phrase": True})
                numbers = index.numbers(w.hash)
                for a, b, label, containment in index.windows(numbers, w.row):
                    r = w.row[a]
                    found[r].append({"label": label, "start": int(a - base[r]), "end": int(b - base[r]), "containment": containment, "phrase": False})
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*[rows.column(x) for x in names], pa.array(np.diff(base).astype(np.int64)), pa.array(found, pa.list_(_FOUND))],
                                                 [*names, "n_words", "licences"])
    return run


def scan(docs: DataFrame, settings: LicenceSettings = LicenceSettings()) -> DataFrame:
    """`docs` with `n_words` and `licences`: array of (label, start, end, containment, phrase), words counted from 0.

    Phrases give their place, templates the words of the window that meets them. Null and empty texts have no words; rows
    with a null id and rows that repeat one are scanned like any other.
    Columns of these names are replaced, all others kept.
    """
    kept = docs.drop("n_words", "licences")
    counted = docs.select("text").mapInArrow(_frequencies(settings), "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    frequency = {r.token: r["count"] for r in counted.collect()}  # a row for each template token
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_scanned(settings, frequency, kept.columns), f"{fields}, n_words long, licences "
                           "array<struct<label: string, start: long, end: long, containment: double, phrase: boolean>>")
