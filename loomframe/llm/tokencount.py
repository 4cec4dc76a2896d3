"""Token counts from a finite-state form of a word-level BPE tokenizer.

`Transducer` is a deterministic transducer over the bytes of a word. A state holds what later bytes can still depend on:
the longest end of the word so far that begins some token, and for the positions in it the last token and the tokens so
far. Every transition is annotated with the tokens it adds (which may be below zero), and every state with what the
word's last byte adds. States and transitions are compiled as they are first needed and then kept, until there are `STATES`;
then compilation starts afresh, so a worker's memory is bounded.

Every text is cut into chunks of `CHUNK` characters, wherever that falls. A chunk's map says what the chunk does to whatever state it is
entered in: reading its `head` from that state ends the open word, `count` tokens follow, and it leaves the state `exit`; a chunk without
white space has no exit of its own and only moves the state on. Maps compose, so a prefix scan over them gives the state and count
after every chunk, whoever worked out the maps; a text's count is the last map, entered at the start state. A state between
chunks holds the transducer's state in the open piece, that piece's class, and what of an apostrophe is still undecided.

The tokenizer's own normaliser and split rule come from the library: the split rule is asked for the class of every character beyond
U+02FF and for the pieces of words that have one. Strings of special tokens count one each and cut the text before it is normalised.

Nulls count as empty texts (0 tokens); texts of any length are taken whole. Repeated rows give repeated rows, an empty table gives
none; a null doc_id stays null; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import bounded_batches
from .wordbpe import PIECES, UNUSUAL, _byte_letters, default_path

LIMIT = 2048
#: Characters in a chunk.
CHUNK = 1 << 12
STATES = 80_000
#: Characters of the words that a worker remembers.
LONGEST = 100
NEVER = 1 << 60


class Transducer:
    """Symbols are bytes; a word's last byte is the symbol 256 + byte. Tokens are strings of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end = model.get("end_of_word_suffix") or ""
        byte = {c: b for b, c in enumerate(_byte_letters())}

        def symbols(token: str) -> str:
            last = bool(end) and token.endswith(end)
            codes = [byte[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * last)

        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[str, str, int]] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = map(symbols, pair if isinstance(pair, list) else pair.split(" "))
            self.rank.setdefault((a, b), i)
            self.made.setdefault(a + b, (a, b, i))
        self.tokens = {*map(chr, range(512)), *self.made}
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.spines: tuple[dict, dict] = {}, {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._afresh()

    def _afresh(self) -> None:
        self.state: dict[tuple, int] = {}
        self.info: list[tuple[str, tuple, tuple]] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.last: list[dict[int, int]] = []
        self.intern(("", (None,), (0,)))

    def intern(self, info: tuple) -> int:
        """The number of a state, which holds until compilation starts afresh."""
        if (found := self.state.get(info)) is None:
            found = self.state[info] = len(self.info)
            self.info.append(info)
            self.next.append({})
            self.last.append({})
        return found

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end (0: left, 1: right) of a token while it is built, each with the rank that merges it away."""
        if (found := self.spines[side].get(token)) is None:
            found, over, inner = [], NEVER, token
            while True:
                found.insert(0, (inner, over))
                if len(inner) == 1:
                    break
                made = self.made[inner]
                inner, over = made[side], made[2]
            self.spines[side][token] = found
        return found

    def compatible(self, left: str | None, right: str) -> bool:
        """Whether BPE keeps these neighbours: no merge across comes before the merges on either side."""
        if left is None:
            return True
        if (known := self.pairs.get((left, right))) is None:
            a, b, i, j, known = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                (x, over_x), (y, over_y) = a[i], b[j]
                across = self.rank.get((x, y), NEVER)
                if across < over_x and across <= over_y and across != NEVER:
                    known = False
                    break
                if over_x <= over_y:
                    if over_x == NEVER:
                        break
                    i += 1
                else:
                    j += 1
            self.pairs[left, right] = known
        return known

    def _read(self, state: int, symbol: str) -> tuple[tuple, int]:
        open_end, last, counts = self.info[state]
        text = open_end + symbol
        for at in range(len(text)):
            token = text[at:]
            if token in self.tokens and self.compatible(last[at], token):
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        count = counts[at] + 1
        keep = next(k for k in range(len(text) + 1) if k == len(text) or text[k:] in self.starts)
        return (text[keep:], (*last, token)[keep:], tuple(c - count for c in (*counts, count)[keep:])), count

    def step(self, state: int, byte: int) -> tuple[int, int]:
        if (found := self.next[state].get(byte)) is None:
            info, added = self._read(state, chr(byte))
            found = self.next[state][byte] = (self.intern(info), added)
        return found

    def finish(self, state: int, byte: int) -> int:
        if (found := self.last[state].get(byte)) is None:
            found = self.last[state][byte] = self._read(state, chr(256 + byte))[1]
        return found

    def count(self, word: bytes) -> int:
        if len(self.info) > STATES:
            self._afresh()
            self.pairs.clear()
        state = total = 0
        step = self.step
        for byte in word[:-1]:
            state, added = step(state, byte)
            total += added
        return total + self.finish(state, word[-1])


#: (class of the open piece: "L" letters, "O" symbols, "" none; transducer state; its last byte, not yet read, or -1; undecided apostrophe)
State = tuple[str, tuple, int, str]
EMPTY = ("", (None,), (0,))
START: State = ("", EMPTY, -1, "")
#: The split rule's own pieces that begin with an apostrophe.
SHORT_FORMS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
_OPENINGS = {"'r", "'v", "'l"}


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the state it is entered in; `exit` is None where it has no white space."""

    head: str
    count: int = 0
    exit: State | None = None


class Counter:
    def __init__(self, path: str, most: int = 120_000):
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = [t.content for t in added]
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)")
        self.transducer = Transducer(path)
        self.pieces = _Remembered(lambda p: self.transducer.count(p.encode()), most)
        self.words = _Remembered(self._word, most)
        self.classes = _Remembered(self._class, most)

    def _word(self, word: str) -> int:
        """Tokens of a whole word: the transducer's runs over its pieces."""
        if not word:
            return 0
        if UNUSUAL.search(word):
            pieces = [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        else:
            pieces = [word] if word.isalpha() else PIECES.findall(word)
        return sum([self.pieces[p] for p in pieces])

    def _class(self, c: str) -> str:
        """L: joins letters, O: joins symbols, N: stands alone, by the split rule itself."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        return "L" if len(split("a" + c)) == 1 else "O" if len(split("!" + c)) == 1 else "N"

    def close(self, state: State) -> int:
        """Tokens that the end of the word adds."""
        kind, q, held, wait = state
        if wait:
            state, n = self._wait_over(wait)
            return n + self.close(state)
        return self.transducer.finish(self.transducer.intern(q), held) if held >= 0 else 0

    def _wait_over(self, wait: str) -> tuple[State, int]:
        """The apostrophe was no short form: it opens a run of symbols."""
        state, n = self._enter(START, "'", "O")
        for c in wait[1:]:
            state, more = self._enter(state, c, "L")
            n += more
        return state, n

    def _enter(self, state: State, c: str, kind: str) -> tuple[State, int]:
        open_kind, q, held, _ = state
        data, n = c.encode(), 0
        if kind != open_kind or kind == "N":
            n = self.close(state)
            if kind == "N":
                return START, n + self.transducer.count(data)
            q, held = EMPTY, -1
        at = self.transducer.intern(q)
        for byte in (*((held,) if held >= 0 else ()), *data[:-1]):
            at, added = self.transducer.step(at, byte)
            n += added
        return (kind, self.transducer.info[at], data[-1], ""), n

    def read(self, state: State, text: str) -> tuple[State, int]:
        """The state after characters of one word, and the tokens they add."""
        total = 0
        for c in text:
            wait = state[3]
            if wait and wait + c in SHORT_FORMS:
                state, n = START, self.transducer.count((wait + c).encode())
            elif wait and wait + c in _OPENINGS:
                state, n = ("", EMPTY, -1, wait + c), 0
            else:
                n = 0
                if wait:
                    state, n = self._wait_over(wait)
                kind = self.classes[c]
                if c == "'" and state[0] != "O":
                    n += self.close(state)
                    state = ("", EMPTY, -1, "'")
                else:
                    state, more = self._enter(state, c, kind)
                    n += more
            total += n
        return state, total

    def chunk(self, text: str, space: str | None = None) -> ChunkMap:
        """The map of a chunk; `space` is what words stand between (None: any white space)."""
        words = text.split(space)
        if len(words) == 1 and words[0] == text:
            return ChunkMap(text)
        if space is None:
            words = [*([""] if text[0].isspace() else []), *words, *([""] if text[-1].isspace() else [])]
        head, *inner, tail = words
        state, n = self.read(START, tail)
        return ChunkMap(head, sum(map(self.words.__getitem__, inner)) + n, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.exit is None:
            return ChunkMap(a.head + b.head, b.count, b.exit)
        state, n = self.read(a.exit, b.head)
        if b.exit is None:
            return ChunkMap(a.head, a.count + n, state)
        return ChunkMap(a.head, a.count + n + self.close(state) + b.count, b.exit)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: pairs are composed, scanned, and filled in between, in a logarithmic number of rounds."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        return [maps[0]] + [pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps))]

    def _plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if UNUSUAL.search(text):
            text, space = self.library.normalizer.normalize_str(text), " "
        else:  # composed already, and its white space is what split() takes for it
            text, space = text.lower(), None
        if not text:
            return 0
        whole = self.scan([self.chunk(text[i : i + CHUNK], space) for i in range(0, len(text), CHUNK)])[-1]
        return self.words[whole.head] + whole.count + (self.close(whole.exit) if whole.exit else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(t in text for t in self.added):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


class _Remembered(dict):
    def __init__(self, work, most: int):
        self.work, self.most = work, most

    def __missing__(self, key):
        found = self.work(key)
        if len(self) < self.most and len(key) <= LONGEST:
            self[key] = found
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter in each Python worker, kept between tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole text."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        count = counter(path).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(x) for x in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
