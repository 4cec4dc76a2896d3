"""Near duplicates where buckets hold several components, and where rows share ids but not texts."""

import random

import brute
import numpy as np
import pytest

from loomframe.llm import neardup


def marked(spark, rows, size=2):
    return neardup.mark(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()


def near_texts(seed, families, members):
    """Families of near copies of one template, some of which are linked to each other and some not."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 60)}"
    out, frame = {}, [f"t{i}" for i in range(12)]
    for f in range(families):
        own = frame + [word() for _ in range(6)]
        for m in range(members):
            words = list(own)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = word()
            out[f * 1000 + m] = " ".join(words)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_of_a_template(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "TEXTS", 7)
    monkeypatch.setattr(neardup, "NEAREST", 1)
    texts = near_texts(seed, 12, 8)
    # With one row a band nearly all texts share buckets, so that what is open is compared by lists and blocks.
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs, 2, rows=1, bands=12).collect()}
    assert got == brute.components(texts, 2)


def test_lists_are_complete(spark):
    """All linked texts meet in a list, whatever their bucket."""
    texts = near_texts(7, 10, 6)
    sets = {k: brute.shingle_set(t, 2) for k, t in texts.items()}
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = neardup.text_sets(frame, 2).join(neardup.signatures(frame, 2).selectExpr("text_hash AS t", "doc_id AS id", "n_shingles AS n"), "t").distinct()
    rows = found.selectExpr("t", "id", "n", "id AS p")
    lists = neardup.rare_lists(rows, found.select("t", "shingles", "bits").dropDuplicates(["t"])).collect()
    at = {}
    for r in lists:
        at.setdefault(r.bucket, set()).add(r.id)
    meet = {(a, b) for own in at.values() for a in own for b in own}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked and all(p in meet for p in linked)


def test_bitmaps_lose_no_link():
    """A bitmap's distance is at most the sets' own, however many bits either has; and blocks find what full sets say."""
    draw = np.random.default_rng(3)
    for _ in range(300):
        n = int(draw.integers(1, 400))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[draw.random(len(x)) > draw.random() * 0.4], draw.integers(0, 2**63, int(draw.integers(0, 60))).astype(np.uint64)]))
        if not len(y):
            continue
        a, b = (np.frombuffer(neardup.parity(v), np.uint8)[None] for v in (x, y))
        size = min(a.shape[1], b.shape[1])
        far = int(np.bitwise_count(neardup.folded(a, size) ^ neardup.folded(b, size)).sum())
        common = len(np.intersect1d(x, y))
        assert far <= len(x) + len(y) - 2 * common
        linked = common * 100 >= (len(x) + len(y) - common) * 80
        i, j, _ = neardup._near([neardup.parity(x), neardup.parity(y)], np.array([len(x), len(y)]), np.array([0]), np.array([1]))
        assert not linked or (i.tolist(), j.tolist()) == ([0], [1])


def test_nearest_pairs():
    i, j, far = np.array([0, 0, 1, 1]), np.array([2, 3, 2, 3]), np.array([1, 2, 3, 4])
    keep, more = neardup._nearest(i, j, far, 1)
    assert keep.tolist() == [True, True, True, False] and more
    assert neardup._nearest(i, j, far, 3)[0].all() and not neardup._nearest(i, j, far, 3)[1]
    assert neardup._nearest(i[:0], j[:0], far[:0], 1)[1] is False


def test_unlike_texts_of_one_template(spark):
    """Thousands of log lines, no two of them linked: the lists stay short, so nothing is compared in blocks."""
    draw = random.Random(1)
    rows = [(i, f"at {draw.randint(0, 9999)} user {draw.randint(0, 9999)} did {draw.randint(0, 9999)} to {draw.randint(0, 9999)} and left") for i in range(4000)]
    out = marked(spark, rows)
    assert sum(r.kept for r in out) == len({t for _, t in rows})


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near_b = b.replace("b39", "c")
    out = marked(spark, [(3, a), (5, a), (5, b), (9, near_b), (9, None), (11, "x y z"), (12, near_b), (None, a), (14, ""), (14, "p q r s")])
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[3] == by[5] == by[9] - {9} == by[12] == {3} and by[11] == {11} and by[14] == {14} and by[None] == {None}
    assert {r.doc_id for r in out if r.kept and r.component_id == 3} == {3}


def test_an_id_with_alike_sizes(spark):
    """Each text is compared with its own set: (7, b) must not be judged by the set of (7, a)."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    out = {r.doc_id: r.component_id for r in marked(spark, [(7, a), (7, b), (20, b.replace("b29", "q")), (21, a.replace("a0", "q"))])}
    assert out == {7: 7, 20: 7, 21: 7}
