"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

import brute
import pytest

import corpus_pipeline
from loomframe.llm.shared import written


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns


def test_quality(outputs):
    before = {r.doc_id: r.text for r in outputs[0].collect()}
    after = {r.doc_id: r for r in outputs[1].collect()}
    assert after
    for i, text in before.items():
        if brute.quality(text)[-1]:
            assert i not in after
        elif i in after:
            lines = text.split("\n")
            assert all(x in lines for x in after[i].text.split("\n")) and after[i].n_chars == len(after[i].text)
        else:
            assert brute.quality(text)[0] >= 50


def test_language(outputs):
    assert {r.doc_id for r in outputs[2].collect()} <= {r.doc_id for r in outputs[1].collect()}
    assert outputs[2].count() >= 0.9 * outputs[1].count()


def test_near_duplicates(outputs):
    texts = {r.doc_id: r.text for r in outputs[2].collect()}
    want = sorted({c for _, c in brute.components(texts, 5).values()})
    assert sorted(r.doc_id for r in outputs[3].collect()) == want


def test_personal_data(outputs):
    before = {r.doc_id: r.text for r in outputs[3].collect()}
    after = {r.doc_id: r.text for r in outputs[4].collect()}
    assert sorted(before) == sorted(after)
    for i, text in before.items():
        spans = brute.personal(text)[1]
        assert not spans or text != after[i]
        for s in spans:
            _, a, b = s.split(":")
            if "email" in s:
                assert text[int(a) : int(b)] not in after[i]


def test_packing(outputs):
    texts = {r.doc_id: r.text for r in outputs[4].collect()}
    pieces = {}
    for r in outputs[5].collect():
        ids = brute.word_ids(texts[r.doc_id]) + [1]
        assert r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert sorted(pieces) == sorted(texts)
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(brute.word_ids(texts[i])) + 1


def test_hard_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names; an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, length long, keys string"
    long = " ".join(f"word{i % 977} other{i % 1009}" for i in range(60_000))
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "k"), (2, long, "en", None, 9, 2, None), (2, long, "en", None, 9, 2, None), (None, long, None, "s", 1, 1, "x")]
    for table in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, sf), name.replace(" ", "-"))
        table.count()

    # What each stage says it does with them, on its own input.
    ids = lambda df: sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect())
    docs = spark.createDataFrame(rows, kind)
    clean = written(corpus_pipeline.quality_rules(spark, docs, sf), "clean")
    assert ids(clean) == [(False, 2), (False, 2), (True, None)] and clean.columns == docs.columns and {r.text for r in clean.collect()} == {long}
    assert ids(corpus_pipeline.near_duplicates(spark, clean, sf)) == [(False, 2), (True, None)]
    assert ids(corpus_pipeline.near_duplicates(spark, docs, sf)) == [(False, 1), (False, 2), (True, None), (True, None)], "empty texts are no duplicates"
    said = [(1, "en", "the cat sat on the mat and the dog ran"), (3, "en", "the bird flew over the house"), (5, None, None), (6, "en", "123 456"), (7, None, "the cat and the bird")]
    spoken = spark.createDataFrame([(i, t, lang, "s", 1, 1, "k") for i, lang, t in said], kind)
    assert {i for _, i in ids(corpus_pipeline.language(spark, spoken, sf))} & {5, 6} == set(), "no letters, no language"
    mail = spark.createDataFrame([(1, "write to a.b@c.de now", "en", "s", 9, 1, "k"), (2, None, "en", "s", 9, 1, "k"), (2, None, "en", "s", 9, 1, "k")], kind)
    out = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, mail, sf).collect()}
    assert out[1].text == "write to <EMAIL> now" and out[1].n_chars == len(out[1].text) and out[2].text is None
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    tokens = {(): 1, (long,): len(brute.word_ids(long)) + 1}
    assert sum(r.length for r in pieces) == 2 * tokens[()] + 3 * tokens[(long,)] and all(r.offset + r.length <= 2048 for r in pieces)
