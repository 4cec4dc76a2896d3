"""Plain Python versions of what the operators promise, for small tables."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
_RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
_TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


def word_ids(text):
    return _TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def byte_bpe(text):
    ids = _TIKTOKEN.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def personal(text):
    spans, counts = [], []
    for kind, (pattern, good) in BASE.items():
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m.group())]
        counts.append(len(found))
        spans += found
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


def shingle_set(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(texts, size):
    """id -> (set size, component) for a dict of texts."""
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for k, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(k)
    for k, s in sets.items():
        shared = {}
        for x in s:
            for o in at[x]:
                if o < k:
                    shared[o] = shared.get(o, 0) + 1
        for o, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[o]) - c):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in texts}


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def url_rule(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for verdict, rule in RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def ranked(vectors, queries, k):
    """query -> [(score, id)] over dicts of usable vectors."""
    ids = sorted(vectors)
    out = {}
    for q in queries:
        out[q] = sorted((math.dist(vectors[q], vectors[i]), i) for i in ids if i != q)[:k]
    return out
