"""What is sent to compare texts in blocks is short, and still says no more than the sets do."""

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import neardup


def test_long_texts_send_brief_bitmaps(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 400, n)) for n in (3, 90, 700, 2500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = neardup.text_sets(rows, 3).cache()
    full, short = ({r.t: r[c] for r in sets.collect()} for c in ("bits", "brief"))
    assert all(short[t] == neardup.brief(full[t]) and len(short[t]) == min(len(full[t]), max(64, len(full[t]) // 4)) for t in full)
    lists = sets.select(F.lit(1).cast("long").alias("bucket"), "t", F.hash("t").cast("long").alias("id"), F.size("shingles").cast("long").alias("n"), F.hash("t").cast("long").alias("p"))
    sent = {m.t: bytes(m.bits) for r in neardup.blocks(sets, lists).collect() for m in r.m}
    assert sent == {t: bytes(b) for t, b in short.items()} and sum(map(len, sent.values())) < sum(map(len, full.values())) / 2


def test_brief_bitmaps_keep_links():
    draw = np.random.default_rng(6)
    for n in (1, 5, 64, 127, 128, 129, 255, 256, 257, 600, 1024, 1030, 4000):
        x = np.unique(draw.integers(0, 1 << 62, n, dtype=np.uint64))
        for cut in (0, len(x) // 20, len(x) // 10):
            y = np.unique(np.r_[x[cut:], draw.integers(0, 1 << 62, cut, dtype=np.uint64)])
            common = len(np.intersect1d(x, y))
            assert common * 100 >= (len(x) + len(y) - common) * neardup.SIMILARITY
            i, _, far = neardup._near([neardup.brief(neardup.parity(v)) for v in (x, y)], np.array([len(x), len(y)]), np.array([0]), np.array([1]))
            assert len(i) == 1 and far[0] <= len(x) + len(y) - 2 * common
