from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from twinsift.functions import codecs, hashing

# Published BLAKE3 test vectors (input bytes count up modulo 251).
VECTORS = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969"}


@pytest.mark.parametrize("n", VECTORS)
def test_blake3(n):
    data = bytes(i % 251 for i in range(n))
    assert hashing.Blake3().update(data).hexdigest() == VECTORS[n]
    assert hashing.Blake3().update(data[: n // 3]).update(data[n // 3 :]).hexdigest() == VECTORS[n]


def test_blake3_as_digest_strategy(spark):
    rows = spark.createDataFrame([("",), (None,)], "c string").select(hashing.blake3_hex(F.col("c")).alias("d"))
    assert [r["d"] for r in rows.collect()] == [VECTORS[0], None]


def test_files_are_read_in_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK", 3)
    (tmp_path / "f").write_bytes(b"0123456789")
    assert hashing.hash_file(str(tmp_path / "f")) == hashlib.sha256(b"0123456789").hexdigest()
    asked = []
    with pytest.raises(hashing.Interrupted):
        hashing.hash_file(str(tmp_path / "f"), should_abort=lambda: asked.append(1) or len(asked) > 2)
    with pytest.raises(OSError):
        hashing.hash_file(str(tmp_path / "missing"))


def test_hex_both_ways(spark):
    row = spark.range(1).select(codecs.digest_hex(F.unhex(F.lit("AB" * 32))).alias("h"), codecs.digest_binary(F.lit("ab" * 32)).alias("b"), codecs.digest_binary(F.lit("abc")).alias("none")).first()
    assert row["h"] == "ab" * 32
    assert bytes(row["b"]) == b"\xab" * 32
    assert row["none"] is None


@pytest.mark.parametrize(("text", "roots"), [("/data,/another", ["/data", "/another"]), (" /a b , ,\t/c\n,", ["/a b", "/c"]), ("", []), (",,", [])])
def test_roots(spark, text, roots):
    assert codecs.roots_of(text) == roots
    assert spark.range(1).select(codecs.parse_roots(F.lit(text)).alias("r")).first()["r"] == roots


def test_unsigned_numbers_wrap():
    assert codecs.wrap_u64((1 << 64) - 1) == -1
    assert codecs.wrap_u64(5) == 5
