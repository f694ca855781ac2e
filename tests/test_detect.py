from __future__ import annotations

import pytest

from twinsift.operators import detect

SCHEMA = "path string, size long, digest string, device long, inode long"


def entries(spark, *rows):
    return spark.createDataFrame([(p, len(c), c, 0, i) for p, c, i in rows], SCHEMA)


def pairs(frame):
    return sorted((r["canonical_path"], r["duplicate_path"]) for r in frame.collect())


@pytest.mark.parametrize("skewed", [False, True])
def test_five_equal_files_give_four_pairs_with_the_least_path(spark, skewed):
    e = entries(spark, *((f"/r{i}/f", "same", i) for i in (3, 1, 5, 2, 4)))
    assert pairs(detect.dupe_pairs(e, skewed=skewed)) == [("/r1/f", f"/r{i}/f") for i in (2, 3, 4, 5)]


@pytest.mark.parametrize("skewed", [False, True])
def test_mixed_groups_and_unique_files(spark, skewed):
    e = entries(spark, ("/a1", "A", 1), ("/a2", "A", 2), ("/b1", "BB", 3), ("/b2", "BB", 4), ("/c", "CCC", 5), ("/e1", "", 6), ("/e2", "", 7))
    assert pairs(detect.dupe_pairs(e, skewed=skewed)) == [("/a1", "/a2"), ("/b1", "/b2"), ("/e1", "/e2")]


def test_a_dry_run_leaves_out_links_of_the_canonical_only(spark):
    e = entries(spark, ("/a", "x", 1), ("/b", "x", 1), ("/c", "x", 2), ("/d", "x", 2))
    assert pairs(detect.dupe_pairs(e)) == [("/a", "/b"), ("/a", "/c"), ("/a", "/d")]
    assert pairs(detect.dupe_pairs(e, dry_run=True)) == [("/a", "/c"), ("/a", "/d")]


def test_paths_listed_twice_are_no_duplicates_of_themselves_but_repeat_their_pairs(spark):
    e = entries(spark, ("/a", "x", 1), ("/a", "x", 1), ("/b", "x", 2), ("/b", "x", 2))
    assert pairs(detect.dupe_pairs(e)) == [("/a", "/b")] * 2


def test_order_of_paths_is_by_bytes(spark):
    e = entries(spark, ("/é", "x", 1), ("/z", "x", 2), ("/B", "x", 3), ("/a", "x", 4))
    assert {c for c, _ in pairs(detect.dupe_pairs(e))} == {"/B"}


def test_no_entries(spark):
    e = entries(spark)
    assert detect.dupe_pairs(e).count() == 0
    assert detect.savings(detect.dupe_pairs(e)).first().asDict() == {"pairs": 0, "bytes": 0}


def test_links_form_the_groups(spark, small):
    from twinsift.plans import fixtures

    e = fixtures.files(spark, small)
    found = detect.dupe_pairs(e).count()
    assert found == sum(r["n"] - 1 for r in detect.dupe_groups(e).collect())
