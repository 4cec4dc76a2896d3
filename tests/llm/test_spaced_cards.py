"""Cards whose digits stand apart."""

import brute
import pytest

from loomframe.llm import pii

SPACED = [
    "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "pay 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 now", "4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2",
    "4 1 1 1 1 1 1 1 1 1 1 1 1 1 11", "0 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4  1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111111111111111", "1 2 3",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(SPACED), (50, "visa 3 7 8 2 8 2 2 4 6 3 1 0 0 0 5")], "doc_id long, text string")


def test_base(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = pii.report(docs).collect()
    assert sum(r.n_card for r in out) >= 5
    for r in out:
        counts, spans = brute.personal(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == counts and set(spans) <= set(filter(None, r.spans.split(","))), texts[r.doc_id]


def test_short(docs):
    assert [r.spans for r in pii.report(docs).where("doc_id = 50").collect()] == ["card_short:5:34"]


def test_redacted(docs):
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[0] == "<CARD>" and out[1] == "pay <CARD> now" and out[50] == "visa <CARD_SHORT>" and out[3] == SPACED[3] and out[8] == SPACED[8]
