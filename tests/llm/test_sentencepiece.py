from __future__ import annotations

import random

import pytest
from helpers import no_docs, odd_docs, odd_rows, with_clashes

from twinsift.llm import sentencepiece_codec as C
from twinsift.llm.registry import tokenizer

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", "  hello  wörld\n\n x▁y \u0000☃  ", " ", "   ", "a" * 30, "<s> </s><0x0A><unk>", "日本語 текст   🙂🙂", "\t tab\r\n", "▁▁ ▁"]


@pytest.fixture(scope="module")
def codec():
    return C.Codec(tokenizer()).ready()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer())


def texts(codec, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    some = ["".join(rng.choices("abcdefghinorst étßü  \n", k=rng.randrange(1, 60))) for _ in range(400)]
    some += ["".join(rng.choices(codec.text[259:], k=rng.randrange(1, 12))) for _ in range(800)]
    return TEXTS + some + [r[1] for r in odd_rows() if r[1] is not None and len(r[1]) < 100_000]


def test_ids_equal_the_librarys(codec, library):
    for t in texts(codec):
        assert list(codec.encode(t)) == library.encode(t)


def test_texts_come_back(codec, library):
    for t in texts(codec, 1):
        ids = codec.encode(t)
        assert codec.decode(ids) == t.replace("▁", " ") == library.decode(list(ids))


def test_a_small_memo_and_pieces_change_nothing(codec, monkeypatch):
    small = C.Codec(tokenizer(), memo=3).ready()
    cut = C.Codec.marked
    monkeypatch.setattr(C.Codec, "marked", lambda self, t: cut(self, t, 5))
    for t in texts(codec, 2)[:300]:
        assert list(small.encode(t)) == list(codec.encode(t))
        assert codec.decode(small.encode(t)) == t.replace("▁", " ")


def test_unigram_models_by_best_sum_of_scores(codec):
    """On short texts, against all segmentations; scores are made up, exact in binary, and tie now and then."""
    toy = C.Codec(tokenizer()).ready()
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = [-2.0, -3.0, -3.5, -2.5, -4.0, -5.0, -6.25, -4.5, -5.5, -5.25]
    toy.model = C.Model(C.UNIGRAM, (("<unk>", 0.0, 2), *((p, s, 1) for p, s in zip(pieces, scores, strict=True))), True)
    import ahocorasick

    toy.automaton = ahocorasick.Automaton()
    for i, p in enumerate(pieces, 1):
        toy.automaton.add_word(p, (len(p), i))
    toy.automaton.make_automaton()
    toy.text, toy.score, toy.least, toy.bytes, toy.unk = ["<unk>", *pieces], [0.0, *scores], min(scores) - 10, {}, 0
    toy.sizes = [len(p) for p in toy.text]

    def best(s: str) -> float:
        if not s:
            return 0.0
        ways = [scores[pieces.index(s[:k])] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces]
        return max(ways + ([toy.least + best(s[1:])] if s[0] not in pieces else []))

    rng = random.Random(5)
    for _ in range(500):
        s = "▁" * rng.randrange(2) + "".join(rng.choices("abcx", k=rng.randrange(1, 9)))
        ids = toy.word(s)
        assert sum(toy.score[i] if i else toy.least for i in ids) == pytest.approx(best(s))
        assert sum(len(toy.text[i]) if i else 1 for i in ids) == len(s)


def test_odd_rows(spark):
    rows = odd_docs(spark)
    got = C.code_texts(with_clashes(rows), tokenizer())
    assert got.count() == rows.count()
    assert got.where("NOT same").count() == 0
    empty = {(r["n_pieces"], r["ids_sha256"]) for r in got.where("doc_id IN (100, 101)").collect()}
    assert len(empty) == 1
    coded = C.encode_texts(with_clashes(rows), tokenizer())
    assert set(coded.columns) == set(with_clashes(rows).columns) - {"text"} | {"ids", "n_pieces", "same"}
    assert coded.where("size(ids) <> n_pieces OR NOT same").count() == 0
    assert C.code_texts(no_docs(spark), tokenizer()).count() == 0
