"""Token ids of a word-level BPE vocabulary, with the library asked once for each distinct word.

The vocabulary's rules split text at white space and character classes before any merge, so the ids of a text are the
ids of its words in a row. Texts whose characters could be normalised (beyond U+02FF), or that hold a special token's
string or an ASCII separator that the library does not see as white space, go through the library whole.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Text for which the library itself is called: unusual characters, or the opening of a special token.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u02ff]|<\\|")
#: What of that an ASCII text, or another one up to U+00FF, can hold.
FEW_UNUSUAL = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: The vocabulary's own split rule.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unusual(text: str) -> bool:
    """Whether UNUSUAL is found in a text. Where no character is beyond U+00FF, plain searches tell, many times as fast as the pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return UNUSUAL.search(text) is not None
    return any(x in text for x in FEW_UNUSUAL)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte (a fixed rule of that file format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; remembers at most `most` words, others are worked out anew."""

    def __init__(self, model, most: int):
        self.model, self.most, self.letters = model, most, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(text)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = found
        return found


class _Chunks(dict):
    """white-space separated chunk -> ids, through its words."""

    def __init__(self, words: _Words, most: int):
        self.words, self.most = words, most

    def __missing__(self, chunk: str) -> bytes:
        words = self.words
        found = words[chunk] if chunk.isalpha() else b"".join([words[p] for p in PIECES.findall(chunk)])
        if len(self) < self.most:
            self[chunk] = found
        return found


class WordBpe:
    def __init__(self, path: str, most: int = 120_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = _Words(self.library.model, most)
        self.chunks = _Chunks(self.words, most)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes; null and empty texts have none."""
        if not text:
            return b""
        if unusual(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 120_000) -> WordBpe:
    """One encoder in each Python worker, kept between tasks."""
    return WordBpe(path, most)
