from __future__ import annotations

import re
from collections import Counter

from helpers import DOCS, no_docs, odd_rows, table, with_clashes

from twinsift.llm import quality_rules as R


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


EXTRA = ["a b c a b c", "a b c d a b c", "x x x x", "# * $ % & | < >", "one\n\none\n one\none", "\x0b\x0c a \r\n b", "a b a b a b " + "w" * 3]


def test_counts_equal_brute_force(spark):
    rows = odd_rows() + [(500 + i, t, None, None, None) for i, t in enumerate(EXTRA)]
    got = R.judge(with_clashes(spark.createDataFrame(rows, DOCS)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert table(got.select(*names)) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert got.where("base_failed AND kept").count() == 0
    assert got.where("kept IS NULL").count() == 0


def test_the_order_of_rules_does_not_change_the_verdict(spark, docs):
    def kept(rules):
        return table(R.judge(docs, rules).select("doc_id", "kept"))

    assert kept(R.RULES) == kept(tuple(reversed(R.RULES))) == kept(None)


def test_each_rule_rejects_its_kind(spark):
    filler = [f"word{i} other{i * 7}" for i in range(60)]
    kinds = {
        "word length": " ".join("x" * 40 + str(i) for i in range(60)), "symbols": " ".join(f"{w}%%" for w in filler), "repeated lines": "\n".join(filler[:20] + ["same line of words"] * 12),
        "letters": " ".join(str(i * 991) for i in range(80)), "capitals": " ".join(filler).upper().translate({ord(c): None for c in "0123456789"}) + " " + " ".join(f"ABC{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)),
        "shouting": " ".join(f"{w}!!" for w in filler), "bullets": "\n".join(f"- {w}" for w in filler), "ellipses": "\n".join(f"{w}..." for w in filler), "distinct words": "one two three four " * 60,
    }
    frame = R.counts(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(kinds.values())], DOCS))
    said = frame.select(*(r.rejects().alias(r.name.replace(" ", "_")) for r in R.RULES)).collect()
    for row, name in zip(said, kinds, strict=True):
        assert row[name.replace(" ", "_")], name


def test_rules_go_by_rejection_per_cost(spark, docs):
    found = R.ordered(docs, size=100)
    assert {r.name for r, _, _ in found} == {r.name for r in R.RULES}
    worth = [share / cost for _, cost, share in found]
    assert worth == sorted(worth, reverse=True)
    again = R.ordered(docs.repartition(1), size=10**6)
    assert again == R.ordered(docs.repartition(1), size=10**6)  # counted, not timed
    assert [s for _, _, s in R.ordered(docs.limit(0))] == [0.0] * len(R.RULES)


def test_good_documents_are_kept(docs, labels):
    lost = R.judge(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed AND NOT kept")
    assert lost.count() <= 1


def test_the_plan_is_native_and_a_filter_does_not_repeat_the_counts(docs):
    frame = R.judge(docs, R.RULES).where("kept")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert "Exchange" not in plan
    assert frame.count() > 0


def test_no_rows(spark):
    assert R.judge(no_docs(spark)).count() == 0
