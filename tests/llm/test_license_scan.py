from __future__ import annotations

import random
import re

from helpers import lower, no_docs, odd_docs, odd_rows, table, with_clashes

from twinsift.llm.license_scan import BASE, RareIndex, scan_licenses, sql

TEXTS = [
    "All Rights Reserved. all rights; RESERVED -- all all rights reserved", "Licensed under CC BY-NC 4.0.", "cc by cc by cc", "ccby cc-by", "This work is licensed under the GNU General Public License, version 3.",
    "general public licenses", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "rights reserved all", "ÀLL rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def brute(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_counts_equal_brute_force(spark):
    rows = odd_rows() + [(200 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = scan_licenses(with_clashes(odd_docs(spark).unionByName(spark.createDataFrame([(200 + i, t, None, None, None) for i, t in enumerate(TEXTS)], odd_docs(spark).schema)), "labels"))
    assert table(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert got.where("score < 0 OR score > 1 OR (n_base > 0 AND score = 0)").count() == 0


def test_the_methods_labels():
    index = RareIndex()
    said = {t: index.scan(t)[5] for t in TEXTS}
    assert said["Licensed under CC BY-NC 4.0."] == "cc-by,cc-by-nc-4.0"
    assert said["Released under the MIT License."] == "mit"
    assert said["Licensed under the Apache License, Version 2.0."] == "apache-2.0"
    assert said["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert said["ÀLL rights reserved"] == ""
    score = lambda t: index.scan(t)[6]
    assert 0 < score("cc by") < score("Licensed under the Apache License, Version 2.0.") < score(FULL_MIT) < 1
    assert score("cc by. all rights reserved") > score("cc by")


MENTIONS = {
    "Licensed under the GNU GPL v3": "gpl-3.0", "gplv2 only": "gpl-2.0", "GNU LGPL version 3": "lgpl-3.0", "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0", "Licensed under Apache-2.0": "apache-2.0", "the MIT licence": "", "GNU GPL": "", "version 3 of the general public": "",
}
FULL_MIT = """Copyright (c) 2024 Somebody. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"


def test_mentions_tags_and_full_texts():
    index = RareIndex()
    for text, label in MENTIONS.items():
        assert set(index.scan(text)[5].split(",")) - {"gpl", "cc-by", "reserved"} == ({label} if label else {""}), text
    assert index.scan(FULL_MIT)[5] == "mit"
    assert index.scan(BSD)[5] == "bsd,bsd-2-clause,bsd-3-clause"
    assert index.scan(BSD.split("3. Neither")[0])[5] == "bsd,bsd-2-clause"
    assert index.scan(BSD.replace("binary form must", "binary form may"))[5] == "bsd"
    assert index.scan(GPL)[5] == "gpl,lgpl,lgpl-3.0"


def brute_labels(text: str) -> str:
    """All places of all templates' mandatory phrases, without an index."""
    index = RareIndex()
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    here = lambda at, p: at >= 0 and tuple(w[at : at + len(p)]) == p
    return ",".join(sorted({
        t.label for t in index.templates for i in range(len(w))
        if here(i, t.phrases[0][1]) and all(any(here(i - t.phrases[0][0] + at + d, p) for d in range(-12, 13)) for at, p in t.phrases[1:])
    }))


def test_labels_equal_brute_force_and_sql(spark):
    import duckdb
    import pyarrow as pa

    rng = random.Random(2)
    texts = [*TEXTS, *MENTIONS, FULL_MIT, BSD, GPL, "", " "]
    for _ in range(60):  # cut, joined and disturbed
        parts = rng.choices([*texts, "some other words"], k=3)
        words = " ".join(parts).split()
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(["noise", "the", "license", ""])
        texts.append(" ".join(words))
    index = RareIndex()
    assert [index.scan(t)[5] for t in texts] == [brute_labels(t) for t in texts]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    got = con.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({sql()})").fetchall()
    assert sorted(got) == sorted((i, *index.scan(t)) for i, t in enumerate(texts))


def test_places_across_pieces_of_a_long_text(monkeypatch):
    from twinsift.llm import license_scan

    cut = license_scan.pieces
    monkeypatch.setattr(license_scan, "pieces", lambda t: cut(t, 7))
    text = "x all rights reserved y " * 40 + "cc by"
    assert RareIndex().scan(text)[:5] == brute(text)
    assert RareIndex().scan("licensed under the apache license version 2 0")[5] == "apache-2.0"


def test_no_rows(spark):
    assert scan_licenses(no_docs(spark)).count() == 0
