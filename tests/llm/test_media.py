from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from helpers import no_docs, odd_docs, odd_rows, table, with_clashes

from twinsift.llm import media as M


def png(w: int = 2, h: int = 3) -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((w + 1) * h))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
JPEG = b"\xff\xd8" + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 5, 7, 0) + b"\xff\xda" + struct.pack(">H", 2) + b"data\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def a_zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 100)
    return out.getvalue()


WEBP = struct.pack("<4sI4s4sI", b"RIFF", 22, b"WEBP", b"VP8 ", 10) + bytes(10)
MP4 = struct.pack(">I4s4sI4s", 20, b"ftyp", b"isom", 0, b"mp41") + struct.pack(">I4s", 16, b"mdat") + bytes(8) + struct.pack(">I4s", 12, b"moov") + bytes(4)
FLAC = b"fLaC" + b"\x80\0\0\x22" + bytes(10) + (44100 << 12 | 1 << 9).to_bytes(4, "big") + bytes(20) + b"\xff\xf8 frame"
MP3 = b"ID3\x03\0\0\0\0\0\0" + (b"\xff\xfb\x90\0" + bytes(413)) * 5


def ogg_page(flags: int, body: bytes) -> bytes:
    page = b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<III", 77, 0, 0) + bytes([1, len(body)]) + body
    r = 0
    for x in page:
        r ^= x << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r >> 31 else 0)) & 0xFFFFFFFF
    return page[:22] + struct.pack("<I", r) + page[26:]


OGG = ogg_page(2, b"head") + ogg_page(0, b"more") + ogg_page(4, b"last")
FILES = {"image/webp": WEBP, "video/mp4": MP4, "audio/ogg": OGG, "audio/wav": M.wav(bytes(range(101))), "image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/zip": a_zip(), "application/gzip": gzip.compress(b"x" * 999), "application/pdf": PDF}


@pytest.mark.parametrize("kind", FILES)
def test_types_are_confirmed_corrected_and_carved(kind):
    s, b = M.Sniffer(), FILES[kind]
    said = s.sniff(b, "text/plain")
    assert (said["type"], said["corrected"]) == (kind, True)
    assert not s.sniff(b, kind)["corrected"]
    held = s.sniff(b"some bytes before " + b + b" and after", "text/plain")
    assert held["type"] == "text/plain"
    assert [(at, n, k) for at, n, k, _ in held["carved"] if k == kind] == [(18, len(b), kind)]


@pytest.mark.parametrize("kind", FILES)
def test_cut_files_are_not_confirmed(kind):
    for n in (len(FILES[kind]) - 1, len(FILES[kind]) // 2, 9):
        assert M.Sniffer().sniff(FILES[kind][:n], "text/plain")["type"] == "text/plain"


def test_a_wrong_checksum_or_length_is_not_confirmed():
    bad = bytearray(png())
    bad[20] ^= 1
    assert M.Sniffer().objects(bytes(bad)) == []
    wav = bytearray(M.wav(b"abcd"))
    wav[40] = 200
    assert M.Sniffer().objects(bytes(wav)) == []


def test_flac_and_mp3():
    assert M.Sniffer().objects(b"ab" + FLAC) == [(2, len(FLAC), "audio/flac", "2ch,44100Hz")]
    assert M.Sniffer().objects(FLAC[:40]) == []
    assert M.Sniffer().objects(b"ab" + MP3 + b"more") == [(2, len(MP3), "audio/mpeg", "5 frames")]
    assert M.Sniffer().objects(MP3[:900]) == []


def test_checksums_of_parts():
    b = bytes(range(256)) * 3000
    c = M.Content(b, {})
    for start, end in ((0, len(b)), (1, 700_001), (65_535, 400_000), (70_000, 70_001), (3, 3)):
        assert c.crc(start, end) == zlib.crc32(b[start:end])


def nested_png(n: int) -> bytes:
    """Heads that are all followed by a chunk up to one common end, with a wrong checksum."""
    head = png()[:33]
    total = n * 41
    return b"".join(head + struct.pack(">I4s", total - (k + 1) * 41 + 20, b"teXt") for k in range(n)) + bytes(40)


@pytest.mark.parametrize("unit", [m for m, _, _ in M.MAGIC] + [b"%PDF-1.4 ", b"%%EOF %PDF-1.4 startxref ", b"PK\x03\x04PK\x05\x06", b"RIFF\xf0\xff\x0f\0WAVEjunk\x04\0\0\0", b"\xff\xd8\xff\xc0\0\x08\x08\0\x05\0\x07\0\xff\xda\0\x02", b"GIF89a\1\0\1\0\0\0\0!\xff\x01x\0,", b"\0\0\0\x10ftypisom\0\0\0\0", ogg_page(2, b"head"), gzip.compress(b"abc"), "nested"], ids=repr)
def test_time_grows_with_the_content(unit):
    """A quarter of a megabyte of one magic string, and half a megabyte."""
    import time

    took = []
    for n in (1, 2):
        b = nested_png(n << 12) if unit == "nested" else unit * ((n << 18) // len(unit))
        start = time.process_time()
        M.Sniffer().objects(b)
        took.append(time.process_time() - start)
    assert took[1] < 3.5 * took[0] + 0.5


def test_sniff_media_of_odd_rows(spark):
    long = b"x" * 3_000_000 + FILES["image/png"]
    rows = [(1, long, None), (2, FILES["image/gif"], "image/gif"), (2, FILES["image/gif"], "image/gif"), (None, b"", None), (3, None, None)]
    frame = spark.createDataFrame(rows, "id long, content binary, declared string").selectExpr("*", "'x' AS media_type", "'x' AS corrected")
    got = M.sniff_media(frame, "content", "declared")
    assert got.columns == ["id", "content", "declared", "media_type", "corrected", "facts", "carved"]
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append(r)
    assert [(c["start"], c["type"]) for c in by[1][0]["carved"]] == [(3_000_000, "image/png")]
    assert len(by[2]) == 2 and by[2][0] == by[2][1]
    assert (by[None][0]["media_type"], by[3][0]["media_type"]) == ("application/octet-stream", None)
    assert M.sniff_media(frame.limit(0), "content").count() == 0


def test_column(spark):
    rows = [(1, FILES["image/png"], "image/gif"), (2, None, "x/y"), (3, b"", "text/plain"), (4, b"zz" + GIF, None)]
    frame = spark.createDataFrame(rows, "id long, content binary, declared string").selectExpr("*", "1 AS facts", "1 AS carved")
    got = {r["id"]: r for r in M.sniff_media(frame, "content", "declared").collect()}
    assert (got[1]["media_type"], got[1]["corrected"], got[1]["facts"]) == ("image/png", True, "2x3")
    assert (got[2]["media_type"], got[2]["carved"]) == (None, [])
    assert (got[3]["media_type"], got[3]["corrected"]) == ("text/plain", False)
    assert bytes(got[4]["carved"][0]["bytes"]) == GIF


def brute(text: str | None) -> tuple:
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % 64 if raw else 64)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def test_payloads_come_back(spark):
    got = M.media_of_texts(with_clashes(odd_docs(spark)))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert table(got.select(*names)) == sorted(((r[0], *brute(r[1])) for r in odd_rows()), key=repr)
    assert got.where("media_bytes <> payload_bytes + 44 OR feature NOT LIKE 'audio/wav(8-bit,%'").count() == 0
    assert M.media_of_texts(no_docs(spark)).count() == 0


def test_the_stored_form_is_a_file_that_others_read():
    import wave

    with wave.open(io.BytesIO(M.wav(b"12345678"))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(99)) == (1, 1, b"12345678")


def test_texts_with_magic_bytes_are_no_media():
    said = M.store("BM RIFF GIF89a PK\x03\x04 %PDF-1.4", M.Sniffer())
    assert said[6].endswith("[]")


def test_a_pdf_with_updates_is_carved_whole():
    whole = PDF + b"\n2 0 obj\nendobj\nstartxref\n40\n%%EOF"
    found = M.Sniffer().objects(b"x" + whole + b" %%EOF " + PDF)
    assert [(at, n) for at, n, _, _ in found] == [(1, len(whole)), (1 + len(whole) + 7, len(PDF))]


def test_a_zip_that_stores_a_zip_is_carved_whole():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", a_zip())
        z.writestr("b", "c" * 50)
    found = M.Sniffer().objects(b"xx" + out.getvalue() + b"yy")
    assert (2, len(out.getvalue()), "application/zip", "2 entries") in found
    assert M.Sniffer().sniff(out.getvalue(), "text/plain")["type"] == "application/zip"
