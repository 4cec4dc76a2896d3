"""Neighbours beside an outlier row, and within large clusters of near copies."""

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import ann


def test_outlier_and_clusters(spark):
    draw = np.random.default_rng(7)
    plain = draw.normal(size=(1500, 16)) / 6
    near = draw.normal(size=(1, 16)) / 6 + draw.normal(size=(2000, 16)) * 1e-4
    x = np.vstack([plain, near]).astype(np.float32)
    x[1, 3] = 1000
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = {}
    for q in range(0, len(x), 50):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        shares.setdefault(q >= 1500, []).append(len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    print({k: float(np.mean(v)) for k, v in shares.items()})
    assert all(np.mean(v) >= 0.9 for v in shares.values())
