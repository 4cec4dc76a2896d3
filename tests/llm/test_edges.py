"""Parts of the operators that the registered queries do not show: chunk maps, appends and edits, checkpoints, samples, scores."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import ann, bytebpe, langid, neardup, packing, pii, quality, rans, tokencount
from loomframe.llm.wordbpe import default_path

PARTS = [*"abcdefgstmlrv'  \n.,!19-$", "don't", "'re", "'ve", "'ll", "’", "—", "你好", "é", "İ", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "|>", "\U0001f600", "٣", "​", "пр"]


def mixed(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_token_counts_across_chunk_edges(monkeypatch, chunk):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    counter = tokencount.Counter(default_path())
    for i in range(400):
        text = mixed(i, i % 60)
        assert counter.count(text) == len(brute.word_ids(text)), repr(text)


def test_long_words_and_texts():
    counter = tokencount.Counter(default_path())
    for text in ("a1'" * 9000, "x" * 20000, "don't " * 5000, mixed(5, 30000), " " * 9000, "你" * 9000):
        assert counter.count(text) == len(brute.word_ids(text))


def test_scan_gives_every_prefix():
    counter, text = tokencount.Counter(default_path()), mixed(3, 900).replace("<|endoftext|>", "").replace("<|", "").lower()
    text = counter.library.normalizer.normalize_str(text)
    cuts = [text[i : i + 7] for i in range(0, len(text), 7)]
    for k, m in enumerate(counter.scan([counter.chunk(c, " ") for c in cuts])):
        got = counter.words[m.head] + m.count + (counter.close(m.exit) if m.exit else 0)
        assert got == len(brute.word_ids("".join(cuts[: k + 1])))


def test_appends_and_edits():
    ranks = bytebpe.ranks(bytebpe.default_path(), bytebpe.default_pattern())
    draw = random.Random(1)

    def whole(data):
        return bytebpe.Prefix(ranks).append(data).ids()

    for i in range(150):
        data = bytes(draw.choice(b"abcdefin  tionerst\xc3\xa9") for _ in range(draw.randint(0, 400)))
        p = bytebpe.Prefix(ranks).append(data[:50])
        p.ids()
        assert p.append(data[50:]).ids() == whole(data) == ranks.merge(data)
        a, b = sorted(draw.randint(0, len(data)) for _ in range(2))
        new = bytes(draw.choice(b"abion er") for _ in range(draw.randint(0, 9)))
        assert p.edit(a, b, new).ids() == whole(data[:a] + new + data[b:])


def test_edits_are_local(monkeypatch):
    ranks = bytebpe.ranks(bytebpe.default_path(), bytebpe.default_pattern())
    p = bytebpe.Prefix(ranks).append(b"the nation of states " * 5000)
    p.ids()
    calls, plain = [], bytebpe.Ranks.last_token
    monkeypatch.setattr(bytebpe.Ranks, "last_token", lambda self, *a: calls.append(1) or plain(self, *a))
    p.edit(1000, 1003, b"xyz")
    assert len(calls) <= 6 * ranks.longest


def test_encode_then_decode(spark):
    texts = [(1, "Hello world  \n x" * 50), (2, None), (3, ""), (None, mixed(1, 500)), (2, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    encoded = bytebpe.encode_documents(docs)
    assert sorted(len(r.ids) for r in encoded.collect()) == sorted(brute.byte_bpe(t)[0] for _, t in texts)
    assert sorted(bytes(r.data) for r in bytebpe.decode_documents(encoded).collect()) == sorted((t or "").encode() for _, t in texts)


@pytest.fixture(scope="module")
def segment():
    ids = (np.random.default_rng(3).zipf(1.3, 200_000) % 40_000).astype(np.uint32)
    return ids, rans.encode_segment([7, 8], [150_000, 50_000], ids)


def test_checkpoints(segment):
    ids, data = segment
    s = rans.Segment(data)
    assert (s.decode() == ids).all() and len(data) < 0.5 * ids.nbytes
    for block in range(s.head["blocks"]):
        own = ids[block * rans.BLOCK : (block + 1) * rans.BLOCK]
        for k in range(len(s.marks)):
            assert (s.decode(range(block, block + 1), k) == own[k * rans.STRIDE * rans.LANES :]).all()


def test_corruption_is_found(segment):
    _, data = segment
    for at in (len(data) // 2, len(data) - 1, 3):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises(ValueError):
            rans.Segment(bytes(bad)).decode()


def test_several_segments(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 9 else 5, f"text number {i} " * 30) for i in range(200)], "doc_id long, text string")
    files = rans.token_files(docs, segment=2000)
    assert files.groupBy("part").count().agg(F.max("count")).first()[0] > 1
    out = rans.read_documents(files)
    assert out.count() == 200 and out.agg(F.sum("n_tokens")).first()[0] == sum(len(brute.word_ids(f"text number {i} " * 30)) + 1 for i in range(200))
    rans.write_files(docs, f"{tmp_path}/files")
    assert rans.read_documents(spark.read.parquet(f"{tmp_path}/files")).count() == 200


def test_sample_is_bounded(spark):
    rows = [(1, "one hot id and text", "en")] * 3000 + [(i, f"text {i}", "de" if i % 3 else "fr") for i in range(3000)] + [(1, f"same id {i}", "es") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["lang"]: r["n"] for r in langid.sample(docs, F.lit(True), 100).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert found == {"en": 1, "de": 100, "fr": 100, "es": 100}


def test_rejection_and_calibration():
    draw = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        lang = "ab"[i % 2]
        texts.append(" ".join("".join(draw.choice("aeioust" if lang == "a" else "bcdfgku") for _ in range(5)) for _ in range(20)))
        labels.append(lang)
    model = langid.train([langid.bag(t) for t in texts], labels)
    out = [model.predict(t) for t in texts]
    assert np.mean([lang == want for (lang, _, _), want in zip(out, labels, strict=True)]) > 0.99
    assert np.mean([s for _, s, _ in out]) > 0.9 and np.mean([r for *_, r in out]) < 0.05
    assert model.predict("aeb cio dus fak")[1] < 1.0 and model.predict("123 !!")[0] == "und" and model.predict(None) == ("und", 0.0, True)


SPANS = [
    ("pay to DE89 3704 0044 0532 0130 00 now", "iban:7:34"), ("pay to DE88 3704 0044 0532 0130 00 now", ""), ("tel 030 1234567", "phone_local:4:15"), ("no 030 1234567", ""),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret:9:49"), ('colour "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ""), ("key averyveryverylongwordwithoutnumbers", ""),
]


def test_added_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPANS)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(docs).collect()}
    assert [out[i].spans for i in range(len(SPANS))] == [s for _, s in SPANS]
    assert out[0].scores == "0.9" and out[4].scores == "0.9" and out[3].scores == ""
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[4] == 'token = "<SECRET>"'


def test_common_lines_whatever_their_hash(spark):
    for k in range(4):
        shared = f"read more about us {'abcd'[k]}"
        docs = [(i, "\n".join([shared, *[" ".join("w" + "abcdefghij"[int(c)] for c in f"{i:04d}{j}{(i * 7919 + j * 104729) % 10**6:06d}") for j in range(7)]]), "site") for i in range(280)]
        out = quality.assess(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
        assert {r.words_removed for r in out} == {5} and not any(r.depleted for r in out)


def test_components_of_hubs(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, 5000) for i in range(1000, 1010)] + [(7000 + i, 7001 + i) for i in range(60)]
    out = {r.id: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 3000)} == {0} and out[5000] == 0 and {out[7000 + i] for i in range(1, 61)} == {7000}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_histogram():
    slots, n = packing.pack_histogram({2048: 1000, 1024: 3, 700: 10, 5: 100})
    assert sum(k for _, _, k, _, _ in slots) == 1113 and n <= 1000 + 2 + 4 + 1


def test_repeated_ids_are_candidates(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.1]), (5, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(by[200]) == [(1, 5, round(2**0.5, 6))]
    near, far = round(0.1, 6), round(2**0.5, 6)
    assert sorted(by[100]) == sorted([(1, 100, 0.0), (2, 3, near), (3, 100, far)] * 2 + [(1, 3, round((1 + 0.81) ** 0.5, 6)), (2, 100, far), (3, 100, far)])
