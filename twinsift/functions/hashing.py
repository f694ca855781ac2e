"""Digests of files and of binary columns, read in chunks with the choice of algorithm.

BLAKE3 follows the published specification (tree of 1 KiB chunks). It runs the compression function with numpy
over all chunks of a block of input at a time, and is meant for checking against indexes that hold BLAKE3
digests; SHA-256 is the default everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes read at a time.
CHUNK = 1 << 20

# Fixed values of the BLAKE3 specification: initial state, permutation of message words, flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
PERMUTE = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


class Interrupted(Exception):
    """A digest was given up because the caller asked for it."""


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (n, 8) of n blocks: cv (n, 8), words (n, 16), and per block its counter, length and flags."""
    v = np.empty((16, len(cv)), dtype=np.uint32)
    v[:8] = cv.T
    v[8:12] = IV[:4, None]
    v[12], v[13], v[14], v[15] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    m = words.T.copy()

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x >> np.uint32(n)) | (x << np.uint32(32 - n))

    def mix(a, b, c, d, x, y) -> None:
        for word, far, near in ((x, 16, 12), (y, 8, 7)):
            v[a] += v[b] + m[word]
            v[d] = turn(v[d] ^ v[a], far)
            v[c] += v[d]
            v[b] = turn(v[b] ^ v[c], near)

    columns, diagonals = [[i, i + 4, i + 8, i + 12] for i in range(4)], [[i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4] for i in range(4)]
    for r in range(7):
        # rows of v are independent within a half round, so four mixes run as one on index lists
        for half, group in enumerate((columns, diagonals)):
            a, b, c, d = (np.array(x) for x in zip(*group, strict=True))
            mix(a, b, c, d, np.arange(8 * half, 8 * half + 8, 2), np.arange(8 * half + 1, 8 * half + 8, 2))
        if r < 6:
            m = m[PERMUTE]
    return (v[:8] ^ v[8:]).T


class Blake3:
    """Incremental BLAKE3-256."""

    def __init__(self) -> None:
        self.rest, self.chunks = b"", 0
        self.stack: list[tuple[int, np.ndarray]] = []  # (chunks below, chaining value)

    def update(self, data: bytes) -> Blake3:
        self.rest += data
        whole = max(0, (len(self.rest) - 1) // 1024)  # the last chunk waits: it may be the root
        if whole:
            blocks = np.frombuffer(self.rest[: whole * 1024], dtype="<u4").reshape(whole, 16, 16)
            counter = np.arange(self.chunks, self.chunks + whole, dtype=np.uint64)
            cv = np.repeat(IV[None], whole, 0)
            for i in range(16):
                cv = _compress(cv, blocks[:, i], counter, np.uint32(64), np.uint32(CHUNK_START * (i == 0) | CHUNK_END * (i == 15)))
            self._push_run(cv)
            self.rest = self.rest[whole * 1024 :]
        return self

    def _push_run(self, cv: np.ndarray) -> None:
        """Chaining values of the next chunks: subtrees that are whole and aligned are reduced level by level at once."""
        while len(cv):
            size = 1 << (len(cv).bit_length() - 1)
            if self.chunks:
                size = min(size, self.chunks & -self.chunks)
            level, cv = cv[:size], cv[size:]
            while len(level) > 1:
                pairs = level.reshape(-1, 16)
                level = _compress(np.repeat(IV[None], len(pairs), 0), pairs, np.zeros(len(pairs), np.uint64), np.uint32(64), np.uint32(PARENT))
            self._push(size, level[0])
            self.chunks += size

    def _push(self, size: int, cv: np.ndarray) -> None:
        while self.stack and self.stack[-1][0] == size:
            size, cv = size * 2, self._parent(self.stack.pop()[1], cv, 0)
        self.stack.append((size, cv))

    @staticmethod
    def _parent(left: np.ndarray, right: np.ndarray, flags: int) -> np.ndarray:
        return _compress(IV[None], np.concatenate([left, right])[None], np.zeros(1, np.uint64), np.uint32(64), np.uint32(PARENT | flags))[0]

    def hexdigest(self) -> str:
        b, cv, top = self.rest, IV, ROOT if not self.stack else 0
        n = max(1, -(-len(b) // 64))
        for i in range(n):
            part = b[64 * i : 64 * i + 64]
            last = i == n - 1
            flags = CHUNK_START * (i == 0) | (CHUNK_END | top) * last
            cv = _compress(cv[None], np.frombuffer(part.ljust(64, b"\0"), dtype="<u4")[None], np.array([self.chunks], np.uint64), np.uint32(len(part)), np.uint32(flags))[0]
        for k, (_, left) in enumerate(reversed(self.stack)):
            cv = self._parent(left, cv, ROOT if k == len(self.stack) - 1 else 0)
        return cv.astype("<u4").tobytes().hex()


ALGORITHMS: dict[str, Callable] = {"sha256": hashlib.sha256, "blake3": Blake3}


def hash_file(path: str, algorithm: str = "sha256", should_abort: Callable[[], bool] | None = None) -> str:
    """Hex digest of a file, read in chunks; the abort is asked before opening, after each chunk and at the end."""

    def ask() -> None:
        if should_abort and should_abort():
            raise Interrupted(path)

    ask()
    h = ALGORITHMS[algorithm]()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
            ask()
    ask()
    return h.hexdigest()


def blake3_hex(content: Column) -> Column:
    """The digest strategy BLAKE3 for a content column, by Arrow batches; null for null."""

    def run(contents: pa.Array) -> pa.Array:
        return pa.array([None if b is None else Blake3().update(b).hexdigest() for b in contents.to_pylist()], pa.string())

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(content.cast("binary"))
