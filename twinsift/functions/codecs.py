"""Scalar functions: digests, hex form, status codes, roots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import OP_DONE, OP_FAILED, OP_PLANNED

#: A digest strategy maps a content column (string or binary) to 64 lower-case hex digits.
DigestFn = Callable[[Column], Column]


def sha256_hex(content: Column) -> Column:
    """The default strategy: built in and inside generated code."""
    return F.sha2(content.cast("binary"), 256)


def digest_hex(digest: Column) -> Column:
    """Lower-case hex of a binary digest."""
    return F.lower(F.hex(digest))


def digest_binary(hexed: Column) -> Column:
    """Inverse of digest_hex; null unless it is 64 hex digits."""
    return F.when(hexed.rlike("^[0-9a-f]{64}$"), F.unhex(hexed))


def op_status(text: Column) -> Column:
    """The status that stored text stands for: what is unknown or missing counts as planned."""
    return F.when(text.isin(OP_DONE, OP_FAILED), text).otherwise(F.lit(OP_PLANNED))


def size_bytes(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def backup_path(duplicate: Column, run_id: str, op_id: Column) -> Column:
    """Name for the duplicate while it is being replaced: the same at each run with the same ids."""
    return F.concat(duplicate, F.lit(f".dd_tmp.{run_id}."), op_id.cast("string"))


def parse_roots(text: Column) -> Column:
    """Comma-separated roots as an array: trimmed, empty ones left out; null for a null text."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.regexp_replace(s, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda s: s != "")


def wrap_u64(x: int) -> int:
    """An unsigned 64-bit number as the signed one of the same bits, as an index stores it."""
    return x - (1 << 64) if x >= 1 << 63 else x


def roots_of(text: str) -> list[str]:
    """parse_roots for the command line."""
    return [r for r in (part.strip(" \t\n\v\f\r") for part in text.split(",")) if r]
