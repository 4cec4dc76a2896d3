"""Quality classifier: held-out accuracy, the update rule against a plain one, edge cases."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import goodness as G
from loomframe.llm import queries as Q


def auc(scores, labels):
    pos, neg = np.array(scores)[np.array(labels) == 1], np.array(scores)[np.array(labels) == 0]
    return float(np.mean(pos[:, None] > neg[None, :]) + 0.5 * np.mean(pos[:, None] == neg[None, :]))


def test_held_out_skill(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = Q.op12_quality_classifier(spark, folder).collect()
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.99
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.98
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 0]) < 0.15


def test_update_is_the_written_rule():
    """Against the update written out for one coordinate at a time."""
    draw = np.random.default_rng(4)
    leader = G.Leader(50)
    z, n, bz, bn = [0.0] * 50, [0.0] * 50, 0.0, 0.0
    for _ in range(300):
        at = np.sort(draw.choice(50, 7, replace=False))
        x, y = draw.random(7), int(draw.random() < 0.5)
        w = [0.0 if abs(z[i]) <= G.L1 else -(z[i] - math.copysign(G.L1, z[i])) / ((G.BETA + math.sqrt(n[i])) / G.ALPHA + G.L2) for i in at]
        b = -bz / ((G.BETA + math.sqrt(bn)) / G.ALPHA)
        p = 1 / (1 + math.exp(-(sum(a * c for a, c in zip(w, x, strict=True)) + b)))
        for i, wi, xi in zip(at, w, x, strict=True):
            g = (p - y) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / G.ALPHA * wi
            n[i] += g * g
        g = p - y
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / G.ALPHA * b
        bn += g * g
        leader.update(at, x, y)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n) and abs(leader.bias_z - bz) < 1e-9


def test_features(monkeypatch):
    draw = random.Random(1)
    text = " ".join(draw.choice(["Alpha", "BETA", "x1", "--", "…", "a,b", "é", "THE", "the the", "#$$", "\n"]) for _ in range(900))
    want = G.features(text)
    for part in (1, 7, 64, 4096):
        monkeypatch.setattr(G, "PART", part)
        got = G.features(text)
        assert (got[0] == want[0]).all() and np.allclose(got[1], want[1])
    for empty in (None, "", " \n\t"):
        assert len(G.features(empty)[0]) == 0
    assert abs(float((want[1].astype(float) ** 2).sum()) - 1) < 1e-5
    a, b = (set(G.features(t)[0]) for t in ("the cat", "THE cat"))
    assert a < b and len(b - a) == 1, "capitals add a mark and nothing else"


SCHEMA = "doc_id long, text string, score int, label string, held_out int"


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, "clash", 2) for d in docs], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_edges(spark):
    docs = [(i, f"good words {i} here." if i % 2 else f"b@d!! {i}") for i in range(40)] + [(None, "x"), (50, None), (51, ""), (52, "w " * 300000), (3, "good words 3 here.")]
    labels = [(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(10)] + [(None, 1), (1, None), (2, 7), (99, 1)]
    out = G.judge(*frames(spark, docs, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert not by[None][0].held_out and by[50][0].score == by[51][0].score and by[3][0].score == by[3][1].score
    assert auc([r.score for r in out if r.doc_id in range(40)], [r.doc_id % 2 for r in out if r.doc_id in range(40)]) > 0.95
    assert G.judge(*frames(spark, [], labels)).count() == 0
    assert {r.score for r in G.judge(*frames(spark, docs, [])).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs, labels = frames(spark, [(i % 900, f"t {i}") for i in range(3000)], [(i, i % 2) for i in range(900)])
    assert G.sample(docs, labels, F.lit(True), 100).count() == 100
    assert G.sample(docs, labels, F.lit(True), 10**6).count() == 3000
