"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one vocabulary token can be its last one in a valid encoding: the token t such
that t is compatible with the last token of what is left without t. Two neighbours are compatible if BPE, run on their
bytes alone, gives just these two tokens. Storing that last token for each prefix gives an encoding by walking back, makes
appending exact (later bytes never change what earlier prefixes stored), and lets an edit re-encode from the edited byte to where the old
and new last tokens agree again.

`Prefix` is one such text; `Ranks` holds the vocabulary. Pieces of the split pattern are encoded separately and the ids of
frequent pieces are remembered.

Nulls count as empty texts (no ids); texts and pieces of any length are encoded whole. A null doc_id stays null. Repeated rows give repeated rows, empty tables none; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Where this does not occur, a text can be cut before every space: no run of white space goes across a cut.
ACROSS = regex.compile(r"\s ")


#: Pieces up to this many bytes are looked up by prefix in one table for all of them.
SHORT = 64


class Ranks:
    """A vocabulary: ranks of byte strings, which are the ids; remembers the ids of at most `most` pieces."""

    def __init__(self, path: str, pattern: str, most: int = 200_000):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.own: dict[int, bool] = {}
        self.most = most
        self.pieces: dict[str, bytes] = {}  # of ASCII pieces and their prefixes, and of other pieces
        self.others: dict[str, bytes] = {}  # of the prefixes of other pieces, their bytes written as Latin-1
        self.latin = {t.decode("latin-1"): r for t, r in self.rank.items()}
        self.packed = {r: struct.pack("<i", r) for r in self.token}
        self.chunks = _Chunks(self, most // 2)

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """BPE by definition, for a few bytes: merge the neighbours of lowest rank, leftmost first; only ranks under `below`."""
        rank, none = self.rank, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [rank.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while scores and (low := min(scores)) < below:
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one, or itself twice for a single byte."""
        data = self.token[token]
        return (token, token) if len(data) == 1 else tuple(self.merge(data, token))[:2]

    def reachable(self, token: int) -> bool:
        """Whether BPE gives this token for its own bytes; others never occur."""
        if (known := self.own.get(token)) is None:
            known = self.own[token] = self.merge(self.token[token]) == [token]
        return known

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens at one end (0: left, 1: right) of a token while it is built, from its outer byte up, each with the rank at which it is merged away."""
        if (known := self.spines[side].get(token)) is None:
            known, over, inner = [], 1 << 60, token
            while True:
                known.insert(0, (self.token[inner], over))
                if len(self.token[inner]) == 1:
                    break
                inner, over = self.halves(inner)[side], inner
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps these neighbours: no merge across their boundary comes before the merges on either side."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            a, b, rank = self.spine(left, 1), self.spine(right, 0), self.rank.get
            i = j = 0
            known = self.reachable(right)
            while known:
                (x, over_x), (y, over_y) = a[i], b[j]
                across = rank(x + y)
                # At equal rank the leftmost merge comes first: the left token's own, then the one across, then the right's.
                if across is not None and across < over_x and across <= over_y:
                    known = False
                    break
                if over_x <= over_y:
                    if over_x == 1 << 60:
                        break
                    i += 1
                else:
                    j += 1
            if len(self.pairs) < 4 * self.most:
                self.pairs[key] = known
        return known

    def last_token(self, data: bytes, last: list[int], stop: int) -> int:
        """The last token of data[:stop]; `last` holds it for each prefix (-1: the empty one, -2: not worked out yet).

        Longer tokens are tried first. What a token stands on is worked out before it, so only prefixes that matter are.
        """
        rank, pairs, compatible, longest = self.rank.get, self.pairs.get, self.compatible, self.longest
        todo = [(stop, min(longest, stop))]
        while todo:
            end, size = todo.pop()
            while size:
                if (token := rank(data[end - size : end])) is not None:
                    before = last[end - size]
                    if before == -2:
                        todo.append((end, size))
                        end -= size
                        size = min(longest, end)
                        continue
                    if before == -1:
                        good = self.reachable(token)
                    elif (good := pairs(before << 32 | token)) is None:
                        good = compatible(before, token)
                    if good:
                        last[end] = token
                        break
                size -= 1
        return last[stop]

    def grown(self, data: str, known: dict[str, bytes]) -> bytes:
        """Ids of a short piece, bytes written as Latin-1: those of a prefix that is known or worked out, and its last token."""
        if (found := known.get(data)) is not None:
            return found
        rank, size = self.latin.get, len(data)
        if size > SHORT:
            ids = Prefix(self).append(data.encode("latin-1")).ids()
            return struct.pack(f"<{len(ids)}i", *ids)
        for at in range(size):
            if (token := rank(data[at:])) is None:
                continue
            if not at:
                if self.reachable(token):
                    found = self.packed[token]
                    break
                continue
            before = self.grown(data[:at], known)
            left = int.from_bytes(before[-4:], "little")
            if (good := self.pairs.get(left << 32 | token)) is None:
                good = self.compatible(left, token)
            if good:
                found = before + self.packed[token]
                break
        if len(known) < self.most:
            known[data] = found
        return found

    def piece(self, text: str) -> bytes:
        """Ids of one match of the split pattern, as little-endian 32-bit integers."""
        if (found := self.pieces.get(text)) is None:
            if text.isascii():
                return self.grown(text, self.pieces)
            found = self.grown(text.encode().decode("latin-1"), self.others)
            if len(self.pieces) < self.most:
                self.pieces[text] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if ACROSS.search(text):
            return np.frombuffer(b"".join(map(self.piece, self.split.findall(text))), "<i4")
        first, *rest = text.split(" ")
        return np.frombuffer(b"".join([*map(self.piece, self.split.findall(first)), *map(self.chunks.__getitem__, rest)]), "<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Chunks(dict):
    """What stands between two single spaces -> ids, the space before it included."""

    def __init__(self, vocabulary: Ranks, most: int):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join(map(self.vocabulary.piece, self.vocabulary.split.findall(f" {chunk}")))
        if len(self) < self.most:
            self[chunk] = found
        return found


class Prefix:
    """The bytes of one piece with the unique valid last token of every prefix."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.data, self.last = ranks, b"", [-1]

    def append(self, more: bytes) -> Prefix:
        self.data += more
        self.last += [-2] * len(more)
        return self

    def edit(self, start: int, stop: int, new: bytes) -> Prefix:
        """Replace data[start:stop]; only prefixes near the edit are worked out again.

        A prefix's last token depends on the last tokens of the `longest` prefixes before it and the bytes between. So once that
        many prefixes in a row, all ending after the edit, have the tokens they had before it, all later ones have too.
        """
        ranks, old, was = self.ranks, self.data, self.last
        moved = len(new) - (stop - start)
        self.data = old[:start] + new + old[stop:]
        self.last = was[: start + 1] + [-2] * (len(self.data) - start)
        same = 0
        for end in range(stop + 1, len(old) + 1):
            before = ranks.last_token(old, was, end) if was[end] == -2 else was[end]
            same = same + 1 if ranks.last_token(self.data, self.last, end + moved) == before else 0
            if same == ranks.longest:
                self.last[end + moved + 1 :] = was[end + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        ranks, data, last = self.ranks, self.data, self.last
        out, end = [], len(data)
        while end:
            if (token := last[end]) == -2:
                token = ranks.last_token(data, last, end)
            out.append(token)
            end -= len(ranks.token[token])
        return out[::-1]


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary in each Python worker, kept between tasks."""
    return Ranks(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids of its whole text."""
    bounded_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        encode = ranks(path, pattern).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids stay null."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        decode = ranks(path, pattern).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each whole text, decode its ids, and give digests of both without sending the ids out of the worker."""
    bounded_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches):
        vocabulary = ranks(path, pattern)
        for b in batches:
            rows: list[list] = [[], [], []]
            for text in b.column(1).to_pylist():
                ids = vocabulary.encode(text).tolist()
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
