"""The registered queries against brute force: the small standard tables, and a table of hard rows."""

import math
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from loomframe.llm import queries as Q

HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "one TWO"),
    (7, "caf\u00e9 na\u00efve \u4f60\u597d \U0001f600 it's 12,345.67 <|endoftext|> a\u00a0b \u2028 c\x1cd"), (8, "x" * 5000), (9, "ab " * 4000), (10, "a1b2" * 700),
    (11, "mail a.b@c.de, x@y, 1.2.3.4.5.6.7.8 999.1.1.1 +49 (30) 1234-5678 4111 1111 1111 1111 and 4111-1111-1111-1112"),
    (12, "a@b.c_d@e.f.g- q@r..s 4111111111111111 1 2 3 +1 +12 (5) 12345678901234567890"), (13, "\u0001 tel 030 1234567 DE89 3704 0044 0532 0130 00 \u0002 1.1.1.1"),
    *[(20 + i, " ".join(f"w{j}" for j in range(100)) + f" end{i // 3}") for i in range(12)], (40, "line\nline\n\nline \n#$% & | <b>\nline"), (41, "tab\tsep\x0bvt\x0cff\rcr"),
    (42, "don't I'll we've \u0130stanbul \u1e9e \ufb01 \u00ad\u200b end"), (43, " leading  double   spaces \n\n\n and  trailing  "), (44, "1234567890 " * 50), (45, "tail" + " " * 300),
]


@pytest.fixture(scope="module", params=["standard", "hard", "empty"])
def folder(request, spark, sf, tmp_path_factory):
    if request.param == "standard":
        return sf
    at = str(tmp_path_factory.mktemp(request.param))
    rows = HARD if request.param == "hard" else []
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), 7, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, length long, _p_text string")
    docs.write.parquet(f"{at}/documents.parquet")
    pages = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7x?q"), (4, "https://example.com/en/8#f"), (5, "ftp://com/en/"), (6, "x://h?a/b"), (7, "x://"), (7, "http://xexample.com/en/7")]
    spark.createDataFrame([(*p, "", "clash") for p in (pages if rows else [])], "page_id long, url string, html string, host string").write.parquet(f"{at}/pages.parquet")
    vectors = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [0.5, None]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [3.0, 4.0]), (None, [1.0, 1.0]), (400, [1.0, 2.0, 3.0])]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def rows(spark, folder, name):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def texts(spark, folder):
    return {r[0]: r[1] for r in rows(spark, folder, "documents")}


def got(spark, folder, query, *columns):
    return sorted(tuple(r) for r in query(spark, folder).select(*columns).collect())


def test_packing(spark, folder):
    docs = texts(spark, folder)
    out = Q.op1_packing(spark, folder).collect()
    pieces, room = {}, {}
    for r in out:
        ids = brute.word_ids(docs[r.doc_id]) + [1]
        assert r.doc_tokens == len(ids) and 0 < r.length <= 2048 and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in docs.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(brute.word_ids(t)) + 1
    used = 0
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    if room:
        assert sorted(room) == list(range(len(room))) and len(room) <= -(-used // 2048) * 1.02 + 1


def test_neighbours(spark, folder):
    out = Q.op2_neighbours(spark, folder).collect()
    usable = [(i, v) for i, v, *_ in rows(spark, folder, "embeddings") if i is not None and v and all(x is not None and x == x and abs(x) != float("inf") for x in v) and any(v)]
    want = []
    for q, (i, v) in enumerate(usable):
        if i % 100 == 0:
            near = sorted((math.dist(v, w), j) for k, (j, w) in enumerate(usable) if k != q and len(w) == len(v))[:10]
            want += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(near)]
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in out]
    assert len(found) == len(want) and [r[:2] for r in sorted(found)] == [r[:2] for r in sorted(want)]
    hits = len({(q, j) for q, _, j, _ in found} & {(q, j) for q, _, j, _ in want})
    assert hits >= 0.95 * len({(q, j) for q, _, j, _ in want})
    vectors = {}
    for i, v in usable:
        vectors.setdefault(i, []).append(v)
    for q, rank, j, score in found:
        assert any(abs(math.dist(v, w) - score) < 1e-9 for v in vectors[q] for w in vectors[j] if len(v) == len(w))
        assert all(s >= score for p, r, _, s in found if p == q and r > rank and len(vectors[q]) == 1)


def test_language(spark, folder):
    out = {r.doc_id: r for r in Q.op3_language_id(spark, folder).collect()}
    docs = rows(spark, folder, "documents")
    assert len(out) == len(docs)
    right = total = 0
    for i, t, lang, *_ in docs:
        r = out[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in t or ""):
            assert r.lang_pred == "und"
        elif r.held_out and len(docs) > 100:
            total += 1
            right += r.lang_pred == lang
    assert right >= 0.9 * total


def test_urls(spark, folder):
    want = sorted((i, *brute.url_rule(u)) for i, u, *_ in rows(spark, folder, "pages"))
    out = got(spark, folder, Q.op4_url_filter, "page_id", "host", "path", F.coalesce("rule", F.lit("")), "verdict")
    assert [(a, b, c, d) for a, b, c, d, _ in out] == sorted((a, b, c, d or "") for a, b, c, d, _ in want)
    ruled = {(a, b, c): e for a, b, c, _, e in want if e}
    assert all(ruled.get((a, b, c), e) == e and e in ("allow", "block") for a, b, c, _, e in out)


def test_personal_data(spark, folder):
    out = Q.op5_personal_data(spark, folder).collect()
    docs = texts(spark, folder)
    assert len(out) == len(docs)
    for r in out:
        counts, spans = brute.personal(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == counts, (r.doc_id, r.spans, spans)
        assert set(spans) <= set(r.spans.split(","))


def test_token_counts(spark, folder):
    want = sorted((i, len((t or "").encode()), len(ids := brute.word_ids(t)), len(ids) > 2048) for i, t in texts(spark, folder).items())
    assert got(spark, folder, Q.op6_token_counts, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_quality(spark, folder):
    want = sorted((i, *brute.quality(t)) for i, t in texts(spark, folder).items())
    out = got(spark, folder, Q.op7_quality_rules, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out == want
    assert not Q.op7_quality_rules(spark, folder).where("base_failed AND kept").count()


def test_byte_bpe(spark, folder):
    want = sorted((i, *brute.byte_bpe(t)) for i, t in texts(spark, folder).items())
    assert got(spark, folder, Q.op8_byte_bpe, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_files(spark, folder):
    at, want = 0, []
    for i, t in sorted(texts(spark, folder).items()):
        ids = brute.word_ids(t) + [1]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got(spark, folder, Q.op9_token_files, "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_near_duplicates(spark, folder):
    want = sorted((i, n, c, i == c) for i, (n, c) in brute.components(texts(spark, folder), 2).items())
    assert got(spark, folder, Q.op10_near_duplicates, "doc_id", "n_shingles", "component_id", "kept") == want
