"""License scans by a positional index of rare words.

A licence template is a sequence of words with mandatory key phrases. The index keeps, for each word of the templates,
in how many templates it is (its IDF) and, for the words of a template's anchor phrase (the one with the rarest word),
its position. A file's words are looked up from the rarest licence word down: the places of a template's rarest word
propose where the template starts, and each further rare word keeps only the starts at which it stands in its position;
most templates end there. A start that survives is verified: the anchor phrase word for word, and every other mandatory
phrase word for word within `slack` words of its position, as names and years make texts longer or shorter.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pieces, text_function

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose every place counts as a base place, and their labels (fixed values of the contract).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words by which a mandatory phrase may be away from its position, and rare words that are intersected.
SLACK, RARE = 12, 3
#: Bits of IDF that halve the doubt that a licence is meant.
HALF = 4.0

# Texts of public licences, lower-cased and without punctuation; "|" stands around mandatory phrases.
_GRANT = "|permission is hereby granted free of charge to any person obtaining a copy| of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions |the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software| the software is provided as is |without warranty of any kind express or implied| including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_TWO = "|redistribution and use in source and binary forms with or without modification are permitted| provided that the following conditions are met 1 |redistributions of source code must retain the above copyright notice| this list of conditions and the following disclaimer 2 |redistributions in binary form must reproduce the above copyright notice| this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_THREE = _TWO + " 3 |neither the name of| the copyright holder nor the names of its contributors may be used to |endorse or promote products derived from this software|"
_PROGRAM = "this program is |free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation| either |version {n}| of the license or at your option any later version"
TEMPLATES = (
    ("mit", _GRANT),
    ("mit", "|permission is hereby granted free of charge to any person obtaining a copy|"),
    ("mit", "released under |the mit license|"),
    ("bsd-2-clause", _TWO),
    ("bsd-3-clause", _THREE),
    ("bsd", "|redistribution and use in source and binary forms|"),
    ("isc", "|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted| provided that |the above copyright notice and this permission notice appear in all copies|"),
    ("isc", "permission to use copy modify and or distribute this software |for any purpose with or without fee is hereby granted|"),
    ("zlib", "this software is provided as is |without any express or implied warranty| in no event will the authors be held liable for any damages arising from the use of this software |permission is granted to anyone to use this software for any purpose including commercial applications|"),
    ("bsl-1.0", "|boost software license version 1 0|"),
    ("unlicense", "this is |free and unencumbered software| released into the public domain"),
    ("unlicense", "this is |free and unencumbered software released into the public domain| anyone is |free to copy modify publish use compile sell or distribute this software|"),
    ("apache-2.0", "licensed under the |apache license version 2 0|"),
    ("apache-2.0", "|licensed under the apache license version 2 0| the license |you may not use this file except in compliance with the license| you may obtain a copy of the license at http |www apache org licenses license 2 0|"),
    ("apache-2.0", "licensed under |apache 2 0|"),
    ("gpl-2.0", "this work is licensed under the |gnu general public license version 2|"),
    ("gpl-3.0", "this work is licensed under the |gnu general public license version 3|"),
    ("gpl-2.0", _PROGRAM.format(name="general public license", n=2)),
    ("gpl-3.0", _PROGRAM.format(name="general public license", n=3)),
    ("lgpl-2.1", _PROGRAM.format(name="lesser general public license", n="2 1")),
    ("lgpl-3.0", _PROGRAM.format(name="lesser general public license", n=3)),
    ("agpl-3.0", _PROGRAM.format(name="affero general public license", n=3)),
    *((f"{k}gpl-{n}.0", f"licensed under the |gnu {k}gpl {v}{n}|") for k, n in (("", 2), ("", 3), ("l", 3), ("a", 3)) for v in ("v", "version ", "")),
    *((f"{k}gpl-{n}.0", f"licensed under |{k}gplv{n}|") for k, n in (("", 2), ("", 3), ("l", 3), ("a", 3))),
    ("lgpl", "licensed under the |gnu lesser general public license|"),
    ("agpl", "licensed under the |gnu affero general public license|"),
    ("mpl-2.0", "this source code form is subject to the terms of the |mozilla public license v 2 0|"),
    ("cc0-1.0", "dedicated to the public domain under |cc0 1 0 universal|"),
    *((f"cc-{k.replace(' ', '-')}-4.0", f"licensed under |cc {k} 4 0|") for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")),
    *((f"cc-{k}-4.0", f"licensed under a |creative commons {name} 4 0 international license|") for k, name in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))),
    *((x.lower(), f"|spdx license identifier {' '.join(WORDS.findall(x.lower()))}|") for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
)

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the template, words; the anchor comes first
    base: bool
    strength: float  # how sure one place makes, 0 to 1


class RareIndex:
    """Postings of the rare words of the templates' anchor phrases."""

    def __init__(self, base=BASE, templates=TEMPLATES, rare: int = RARE, slack: int = SLACK) -> None:
        self.slack = slack
        read = [(label, *self._read(f"|{text}|"), True) for text, label in base] + [(label, *self._read(text), False) for label, text in templates]
        df = Counter(w for _, words, _, _ in read for w in set(words))
        self.idf = {w: math.log2((1 + len(read)) / n) for w, n in df.items()}
        self.templates: list[Template] = []
        self.rare: list[list[tuple[str, int]]] = []  # of each template: rare words from the rarest down, with their places
        self.first: dict[str, list[int]] = defaultdict(list)  # rarest word to templates
        for i, (label, words, phrases, is_base) in enumerate(read):
            anchor = min(range(len(phrases)), key=lambda k: (-max(self.idf[w] for w in phrases[k][1]), k))
            ordered = (phrases[anchor], *phrases[:anchor], *phrases[anchor + 1 :])
            mass = sum(self.idf[w] for w in {w for _, phrase in phrases for w in phrase})
            self.templates.append(Template(label, words, ordered, is_base, round(1 - 2 ** (-mass / HALF / 4), 6)))
            at, phrase = ordered[0]
            places = {w: at + k for k, w in reversed(list(enumerate(phrase)))}
            self.rare.append(sorted(places.items(), key=lambda x: (-self.idf[x[0]], x[1]))[:rare])
            self.first[self.rare[-1][0][0]].append(i)
        self.wanted = frozenset(w for some in self.rare for w, _ in some)
        self.longest = max(len(t.words) for t in self.templates) + slack

    @staticmethod
    def _read(text: str) -> tuple[tuple[str, ...], tuple[tuple[int, tuple[str, ...]], ...]]:
        """(words, mandatory phrases with their places) of a marked text."""
        words: list[str] = []
        phrases = []
        for k, part in enumerate(text.split("|")):
            if k % 2:
                phrases.append((len(words), tuple(part.split())))
            words += part.split()
        return tuple(words), tuple(phrases)

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        """All verified (template, start), in order; a start may lie before the text if the phrases do not."""
        found: dict[str, list[int]] = {}
        wanted = self.wanted
        for i, w in enumerate(words):
            if w in wanted:
                found.setdefault(w, []).append(i)
        out, sets = [], {}
        for w in sorted(found, key=lambda w: (-self.idf[w], w)):
            for t in self.first.get(w, ()):
                rare = self.rare[t]
                starts = [i - rare[0][1] for i in found[w]]
                for other, at in rare[1:]:
                    if other not in found:
                        starts = []
                        break
                    here = sets.get(other)
                    if here is None:
                        here = sets[other] = set(found[other])
                    starts = [s for s in starts if s + at in here]
                    if not starts:
                        break
                out += [(t, s) for s in starts if self._verified(t, s, words)]
        return sorted(out)

    def _verified(self, t: int, start: int, words: list[str]) -> bool:
        def stands(at: int, phrase: tuple[str, ...]) -> bool:
            return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase

        (at, anchor), *others = self.templates[t].phrases
        return stands(start + at, anchor) and all(any(stands(start + k + d, phrase) for d in range(-self.slack, self.slack + 1)) for k, phrase in others)

    def scan(self, text: str) -> tuple:
        """One text, piece by piece; each piece begins with the last words of the one before, so none hides a place."""
        found: set[tuple[int, int]] = set()
        words: list[str] = []
        done = 0  # words before `words`
        for piece in pieces(ascii_lower(text)):
            keep = words[-2 * self.longest :]
            done += len(words) - len(keep)
            words = keep + WORDS.findall(piece)
            found.update((t, done + s) for t, s in self.places(words))
        base = [s for t, s in found if self.templates[t].base]
        labels = {self.templates[t].label for t, _ in found}
        named = {self.templates[t].label for t, _ in found if self.templates[t].base}
        doubt = 1.0
        for label in sorted(labels):
            doubt *= 1 - max(self.templates[t].strength for t, _ in found if self.templates[t].label == label)
        return done + len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), round(1 - doubt, 6)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE, slack: int = SLACK) -> DataFrame:
    """One row per row of `docs`: id, word count, places of the base phrases, labels and score.

    The score is the probability-like sum of the labels' strengths: each label leaves a doubt that halves with the IDF
    of its best template's mandatory words, and doubts multiply. A null or empty text has no words, no places (null
    first and last word), empty labels and score 0. Repeated rows give repeated results; other columns are not read.
    Nothing is shuffled.
    """
    index = RareIndex(rare=rare, slack=slack)
    found = text_function(index.scan, SCHEMA, docs.sparkSession)
    return docs.select(F.col(doc_id), found(F.col(text)).alias("_found")).select(doc_id, "_found.*")


def sql() -> str:
    """The scan in DuckDB, for the templates above: all places of the mandatory phrases, word for word."""
    index = RareIndex()
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [
        f"({i}, '{t.label}', {str(t.base).lower()}, {t.strength!r}e0, {quoted(t.phrases[0][1])}, {t.phrases[0][0]}, [{', '.join(quoted(p) for _, p in t.phrases[1:])}]::VARCHAR[][], {[at for at, _ in t.phrases[1:]]}::INT[])"
        for i, t in enumerate(index.templates)
    ]
    return rf"""
WITH templates(t, label, base, strength, phrase, place, others, places) AS (VALUES {", ".join(rows)}), held AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), tokens AS (
  SELECT r, words, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM held
), anchored AS (
  SELECT r, words, t, label, base, strength, i - 1 - place AS start, others, places FROM tokens JOIN templates ON w = phrase[1] WHERE words[i : i + len(phrase) - 1] = phrase
), looked AS (
  SELECT *, unnest(others) AS other, unnest(places) AS spot FROM anchored WHERE len(others) > 0
), stood AS (
  SELECT r, t, start, bool_and(len(list_filter(range(-{SLACK}, {SLACK + 1}), lambda d: start + spot + d >= 0 AND words[start + spot + d + 1 : start + spot + d + len(other)] = other)) > 0) AS ok
  FROM looked GROUP BY r, t, start
), found AS (
  SELECT a.r, label, base, strength, a.start FROM anchored a LEFT JOIN stood s ON s.r = a.r AND s.t = a.t AND s.start = a.start WHERE len(others) = 0 OR s.ok
), sure AS (
  SELECT r, exp(sum(ln(1 - strength))) AS doubt FROM (SELECT r, label, max(strength) AS strength FROM found GROUP BY r, label) GROUP BY r
), each_ AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(1 - coalesce(doubt, 1.0), 6) AS score
FROM held LEFT JOIN each_ USING (r) LEFT JOIN sure USING (r)
"""
