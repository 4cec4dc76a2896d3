"""Language ID is trained in a task; its sample does not come to the driver."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm import langid


def test_no_sample_comes_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{('alpha beta', 'gamma delta')[i % 2]} {i}", ("x", "y")[i % 2]) for i in range(60)], "doc_id long, text string, lang string").cache()
    found = sorted(((r.lang, r.h, r.text) for r in langid.sample(docs, F.lit(True)).collect()))
    own = langid.train([langid.bag(t) for *_, t in found], [lang for lang, *_ in found])
    monkeypatch.setattr(DataFrame, "toArrow", None)
    monkeypatch.setattr(type(docs), "toArrow", None)
    got = langid.fit(docs, F.lit(True))
    assert got.langs == own.langs == ["x", "y"] and np.array_equal(got.logits, own.logits) and np.array_equal(got.bias, own.bias) and (got.temperature, got.cut) == (own.temperature, own.cut)
    assert langid.fit(docs, F.lit(False)).langs == [] and langid.fit(docs.limit(0), F.lit(True)).predict("alpha")[0] == "und"
