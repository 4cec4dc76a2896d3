"""Lines that a host's documents share, however many of them there are."""

import hashlib
import random
import re

import brute
import duckdb
import pytest

from loomframe.llm import quality

KIND = "doc_id long, text string, source string"


def _words(seed, n):
    return " ".join("w" + hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(n))


def test_lines_of_all_documents(spark):
    shared = [_words(f"shared {i}", 4) for i in range(30)]
    docs = [(i, "\n".join([*shared, _words(f"own {i}", 300)]), "site") for i in range(200)]
    out = quality.assess(spark.createDataFrame(docs, KIND)).collect()
    assert {r.words_removed for r in out} == {120} and all(r.kept for r in out)
    assert {r.text for r in quality.clean(spark.createDataFrame(docs, KIND)).collect()} == {t.split("\n")[-1] for _, t, _ in docs}


def test_depleted(spark):
    shared = [_words(f"shared {i}", 4) for i in range(30)]
    out = quality.assess(spark.createDataFrame([(i, "\n".join([*shared, _words(f"own {i}", 9)]), "site") for i in range(200)], KIND)).collect()
    assert all(r.depleted and not r.kept for r in out)


def test_copies_count_once(spark):
    text = "\n".join(_words(f"copied {i}", 9) for i in range(20))
    docs = [(i, text, "site") for i in range(100)] + [(100 + i, _words(f"other {i}", 90), "site") for i in range(100)]
    assert {r.words_removed for r in quality.assess(spark.createDataFrame(docs, KIND)).collect()} == {0}


FOOTER = "all rights reserved by the site"


def cut_of(spark, docs):
    return [r.words_removed for r in quality.assess(spark.createDataFrame(docs, KIND)).orderBy("doc_id").collect()]


def test_a_footer_of_all_documents(spark):
    """Whether documents differ in words, differ only in digits, or are swamped by copies of one that has the footer too."""
    words = [(i, f"{_words(f'page {i}', 60)}\n{FOOTER}", "site") for i in range(100)]
    digits = [(i, f"{_words('page', 30)} number {i} of {i * 7}\nprice {i + 1000}\n{FOOTER}", "site") for i in range(100)]
    copies = words + [(1000 + i, f"{_words('copied', 60)}\n{FOOTER}", "site") for i in range(2900)]
    assert set(cut_of(spark, words)) == {6} and set(cut_of(spark, copies)) == {6}
    assert min(cut_of(spark, digits)) >= 6


def expected(docs):
    """kept, from the words of the rules."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda line: re.sub("[0-9]", "0", line.strip(" \t\n\x0b\x0c\r").lower())
    hosts = {}
    for _, t, h in docs:
        hosts.setdefault(h or "", set()).add(t or "")
    common = set()
    for h, texts in hosts.items():
        having = {}
        for t in texts:
            for line in {key(x) for x in t.split("\n") if words(x)}:
                having[line] = having.get(line, 0) + 1
        common |= {(h, line) for line, n in having.items() if n > quality.MIN_DOCS and n > quality.SHARE * len(texts)}
    out = []
    for i, t, h in docs:
        n = len(words(t))
        gone = sum(len(words(x)) for x in (t or "").split("\n") if words(x) and (h or "", key(x)) in common)
        depleted = gone > 0 and (n - gone < quality.LEAST_WORDS or n - gone < quality.LEAST_LEFT * n)
        out.append((i, gone, not brute.quality(t)[-1] and not depleted))
    return out


def drawn(seed):
    draw = random.Random(seed)
    shared = [f"Line {k} {_words(k, draw.randint(1, 12))}" for k in range(12)]
    docs = []
    for i in range(400):
        lines = [draw.choice(shared).upper() if draw.random() < 0.2 else draw.choice(shared) for _ in range(draw.randint(0, 6))] + [_words((seed, i, j), draw.choice([0, 3, 40])) for j in range(3)]
        docs.append((i, None if i % 97 == 0 else "\n".join(lines), draw.choice(["a", "a", "a", "b", None])))
    return docs + [(1000 + i, *docs[3][1:]) for i in range(200)]


def test_kept_by_brute_force(spark, tmp_path):
    docs = drawn(5)
    frame = spark.createDataFrame(docs, KIND)
    want = expected(docs)
    assert sorted((r.doc_id, r.words_removed, r.kept) for r in quality.assess(frame).collect()) == want
    assert any(g and k for _, g, k in want) and any(g and not k for _, g, k in want)
    assert quality.clean(frame).count() == sum(k for *_, k in want)
    frame.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(f"SELECT doc_id, words_removed, kept FROM ({quality.sql()})").fetchall()) == want


@pytest.mark.parametrize("bits", [0, 3])
def test_windows_of_one_hash(spark, monkeypatch, bits):
    """With few bits for positions every longer text takes the plain way."""
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    draw = random.Random(bits)
    docs = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60))), "s") for i in range(60)]
    out = {r.doc_id: r.n_repeat_words for r in quality.assess(spark.createDataFrame(docs, KIND)).collect()}
    assert out == {i: brute.quality(t)[4] for i, t, _ in docs}
