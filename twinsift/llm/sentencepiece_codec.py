"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reports, in one pass over the symbols, every piece that ends at each position (its output
links go from a piece to its suffixes that are pieces). The Viterbi step relaxes the best way to reach that
position over those pieces:

* unigram models: the best sum of piece scores; a symbol that no piece covers costs the lowest score less 10;
* BPE models: a way is admissible if the last two pieces stay apart when the model's merges run over their
  joint text. Merges go by priority and from left to right, so a sequence of pieces is the model's own result
  exactly if each two neighbours stay apart; one piece at most is admissible at each position, and it is
  relaxed in place of a sum of scores, which would not give the ids of a BPE model.

A vocabulary without white-space marks inside pieces never joins two words, so words (letters and other symbols
apart, if no piece mixes them) are encoded alone and kept in a bounded memo. Symbols outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_function

#: Fixed values of the public model format.
MARK, NORMAL, USER, UNUSED, BYTE = "▁", 1, 4, 5, 6
UNIGRAM, BPE = 1, 2
LESS = 10.0
LOST = float("-inf")


def _fields(b: bytes):
    """Fields of a protocol-buffer message: number, value (int or bytes)."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            c = b[i]
            n |= (c & 127) << shift
            i, shift = i + 1, shift + 7
            if c < 128:
                return n, i

    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


@dataclass(frozen=True)
class Model:
    kind: int
    pieces: tuple[tuple[str, float, int], ...]  # text, score, type
    prefix: bool  # a space goes before the text

    @classmethod
    def of(cls, data: bytes) -> Model:
        """The model in a file's bytes."""
        import struct

        pieces, kind, prefix = [], UNIGRAM, True
        for k, v in _fields(data):
            if k == 1:
                x = dict(_fields(v))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif k == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
            elif k == 3:
                x = dict(_fields(v))
                prefix = bool(x.get(3, 1))
                if x.get(2) or x.get(4, 1) or not x.get(5, 1):
                    raise ValueError("only models that keep the text as it is are supported: no character map, no removal of white space")
        return cls(kind, tuple(pieces), prefix)


class Codec:
    """Encoder and decoder of one model. At most twice `memo` words keep their ids.

    The model's file is read where the codec is made and its bytes go with the job: executors need no such file.
    """

    def __init__(self, path: str, memo: int = 400_000) -> None:
        with open(path, "rb") as f:
            self.data = f.read()
        self.bound = memo
        self.model = None

    def __getstate__(self) -> dict:
        return {"data": self.data, "bound": self.bound, "model": None}  # built again where it is used

    def ready(self) -> Codec:
        if self.model is None:
            m = self.model = Model.of(self.data)
            self.own = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
            if any(MARK in p.lstrip(MARK) for p in self.own):
                raise ValueError("a piece has a white-space mark inside: words cannot be encoded alone")
            self.score = [s for _, s, _ in m.pieces]
            self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
            self.is_byte = np.array([kind == BYTE for _, _, kind in m.pieces])
            self.unk = next(i for i, x in enumerate(m.pieces) if x[2] == 2)
            self.least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0) - LESS
            self.history: dict[int, tuple] = {}
            a = ahocorasick.Automaton()
            for p, i in self.own.items():
                if m.kind == BPE:  # a piece that the merges never make is in no result
                    left, *self.history[i] = self.merges(p)
                    if left != [p]:
                        continue
                a.add_word(p, (len(p), i))
            a.make_automaton()
            self.automaton = a
            self.memo: dict[str, tuple[int, ...]] = {}
            self.older: dict[str, tuple[int, ...]] = {}
            self.apart: dict[int, bool] = {}
            self.shift = len(m.pieces).bit_length()
            self.text = [p for p, _, _ in m.pieces]
            self.sizes = list(map(len, self.text))
            self.back = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind in (NORMAL, USER, UNUSED) else b"" for p, _, kind in m.pieces]
            self.words = re.compile(self.splitting())
        return self

    def splitting(self) -> str:
        """The pattern of what is encoded alone: at white space, and between letters and other symbols if no piece mixes them.

        A letter beyond ASCII that some piece does mix with others counts as one of the others. Finer words are
        more often the same ones.
        """
        other = {"_"}
        letter = lambda c: c not in other and re.match(r"\w", c) is not None
        while True:
            seams = ((a, b) for p in self.own for a, b in pairwise(p.lstrip(MARK)) if letter(a) != letter(b))
            mixed = {c for seam in seams for c in seam if letter(c)}
            if not mixed:
                others = "".join(map(re.escape, sorted(other)))
                return rf"{MARK}*(?:[^\W{others}]+|[\W{others}]+?(?=[^\W{others}]|{MARK}|\Z))|{MARK}+"
            if any(c.isascii() for c in mixed):
                return f"{MARK}*[^{MARK}]+|{MARK}+"
            other |= mixed

    # encoding

    def encode(self, text: str) -> array:
        self.ready()
        out: list[int] = []
        memo = self.memo
        for word in chain.from_iterable(map(self.words.findall, self.marked(text))) if text else ():
            try:
                out += memo[word]
            except KeyError:
                ids = self.older.get(word) or self.word(word)
                if len(word) <= 64:
                    if len(memo) >= self.bound:  # a full memo becomes the older one; frequent words come back from it
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[word] = ids
                out += ids
        return array("i", out)

    def marked(self, text: str, limit: int = 1 << 20) -> Iterator[str]:
        """The text with its marks, in pieces that end where a mark follows another symbol: no word runs over such a place."""
        text = MARK * self.model.prefix + text.replace(" ", MARK)
        at = 0
        while len(text) - at > limit:
            end = at + limit
            while end < len(text) and (text[end] != MARK or text[end - 1] == MARK):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def word(self, s: str) -> tuple[int, ...]:
        last = self.by_merges(s) if self.model.kind == BPE else self.by_score(s)
        ids: list[int] = []
        at = len(s)
        while at:
            i = last[at]
            if i < 0:
                ids += [self.bytes[b] for b in reversed(s[at - 1].encode())] if self.bytes else [self.unk]
                at -= 1
            else:
                ids.append(i)
                at -= self.sizes[i]
        ids.reverse()
        return tuple(ids)

    def by_score(self, s: str) -> list[int]:
        """The last piece (-1: none covers the symbol) of the best way to each position, by sum of scores."""
        n = len(s)
        best, last, at = [0.0] + [LOST] * n, [-1] * (n + 1), 0
        single = [False] * (n + 1)
        for end, (k, i) in self.automaton.iter(s):
            while at < end:  # all pieces that end before are relaxed
                at += 1
                if not single[at] and best[at - 1] + self.least > best[at]:
                    best[at], last[at] = best[at - 1] + self.least, -1
            to = end + 1
            if k == 1:
                single[to] = True
            if (x := best[to - k] + self.score[i]) > best[to]:
                best[to], last[to] = x, i
        while at < n:
            at += 1
            if not single[at] and best[at - 1] + self.least > best[at]:
                best[at], last[at] = best[at - 1] + self.least, -1
        return last

    def by_merges(self, s: str) -> list[int]:
        """The last piece (-1: the symbol is in no piece) of the merged form of each prefix."""
        last = [-1] * (len(s) + 1)
        apart, shift = self.apart.get, self.shift
        for end, (k, i) in self.automaton.iter(s):  # longest first at each end
            end += 1
            if last[end] < 0:
                left = last[end - k]
                if left < 0:
                    last[end] = i
                else:
                    ok = apart(left << shift | i)
                    if ok or ok is None and self.keep_apart(left, i):
                        last[end] = i
        return last

    def keep_apart(self, left: int, right: int) -> bool:
        """Whether the merges of the pieces' joint text end in these two pieces.

        Until a merge runs over the seam, each side merges as it does alone, the best of both first. So it is
        enough to interleave the two known histories and to see whether the symbols at the seam ever come first:
        before what is worse on the left, before what is not better on the right.
        """
        one, two = self.history[left], self.history[right]
        i = j = 0
        while True:
            seam = self.own.get(one[1][i][1] + two[1][j][0])
            a = one[0][i] if i < len(one[0]) else LOST
            b = two[0][j] if j < len(two[0]) else LOST
            if seam is not None and self.score[seam] > a and self.score[seam] >= b:
                ok = False
                break
            if a == b == LOST:
                ok = True
                break
            if a >= b:
                i += 1
            else:
                j += 1
        if len(self.apart) > 4 * self.bound:
            self.apart.clear()
        self.apart[left << self.shift | right] = ok
        return ok

    def merges(self, s: str) -> tuple[list[str], list[float], list[tuple[str, str]]]:
        """Symbols left by the merges over a short text (by priority, the leftmost first), the scores of the merges
        in turn, and the first and last symbols before and after each."""
        part: list[str] = list(s)
        before, after = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap: list[tuple[float, int, int, str]] = []
        scores, edges, last = [], [(s[0], s[-1])], len(s) - 1

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(s) and (k := self.own.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, part[i] + part[j]))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            score, i, j, both = heapq.heappop(heap)
            if part[i] and part[j] and part[i] + part[j] == both and after[i] == j:
                part[i], part[j] = both, ""
                after[i] = after[j]
                if after[j] < len(s):
                    before[after[j]] = i
                else:
                    last = i
                scores.append(-score)
                edges.append((part[0], part[last]))
                offer(before[i], i)
                offer(i, after[i])
        return [p for p in part if p], scores, edges

    # decoding

    def decode(self, ids) -> str:
        self.ready()
        back = self.back
        text = b"".join([back[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


SCHEMA = "n_chars long, n_pieces long, n_bytes_pieces long, ids_sha256 string, decoded_sha256 string, same boolean"


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The rows without their text but with ids (array<int>), n_pieces and same (the decoded text equals the text).

    A null text counts as empty and has no ids. Columns of `docs` with these names are replaced.
    """
    codec = Codec(model)

    def code(t: str) -> tuple:
        ids = codec.encode(t)
        return ids, len(ids), codec.decode(ids) == t.replace(MARK, " ")

    made = text_function(code, "ids array<int>, n_pieces long, same boolean", docs.sparkSession)(F.col(text))
    rest = [c for c in docs.columns if c not in (text, "ids", "n_pieces", "same")]
    return docs.select(*rest, made.alias("_coded")).select(*rest, "_coded.*")


def digest(text: str, codec: Codec) -> tuple:
    """Encodes, decodes and compares one text; ids count as 4 little-endian bytes in their digest."""
    ids = codec.encode(text)
    back = codec.decode(ids)
    raw = int(codec.is_byte[np.frombuffer(ids, np.int32)].sum())
    return len(text), len(ids), raw, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")


def code_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: counts and digests of the ids and of the text decoded from them.

    `same`: the decoded text equals the text, in which the mark U+2581 counts as a space (the model's format
    writes both alike). A null text counts as empty and has no ids. Repeated rows give repeated results;
    other columns are not read. Nothing is shuffled.
    """
    codec = Codec(model)
    made = text_function(lambda t: digest(t, codec), SCHEMA, docs.sparkSession)
    return docs.select(F.col(doc_id), made(F.col(text)).alias("_coded")).select(doc_id, "_coded.*")
