"""Texts that are compared with each other in blocks: what comes out of a step grows with the texts, not with their pairs."""

from collections import Counter

import brute
import numpy as np

from loomframe.llm import neardup


def unlike(q):
    """q * q texts of one template (q prime), seven words of each drawn as points of a line: two texts have at most one of these in common, so no two are
    linked (0.784 at most); those that have one meet in its list, and bitmaps leave many of these pairs open."""
    frame = [f"t{i}" for i in range(100)]
    at = {6 + 14 * x: x for x in range(7)}
    return {a * q + b: " ".join(f"p{at[i]}v{(a * at[i] + b) % q}" if i in at else w for i, w in enumerate(frame)) for a in range(q) for b in range(q)}


def made(spark, monkeypatch, texts):
    """Rows made by each step of Python over batches, by its number and columns; and the components."""
    counts, frame = {}, spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    kind = type(frame)
    plain = kind.mapInArrow

    def counted(self, run, schema, *rest, **more):
        seen = counts.setdefault((len(counts), schema), spark.sparkContext.accumulator(0))

        def each(batches):
            for b in run(batches):
                seen.add(b.num_rows)
                yield b

        return plain(self, each, schema, *rest, **more)

    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", counted)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(frame, 2, rows=1, bands=12).collect()}
    return Counter({k: v.value for k, v in counts.items()}), got


def test_rows_follow_texts(spark, monkeypatch):
    texts = unlike(17)
    rows, got = made(spark, monkeypatch, texts)
    assert got == brute.components(texts, 2) and len({c for _, c in got.values()}) == len(texts)
    # Each text is in the lists of its seven words, with 16 others in each, and in one of the template's; and is sent to two pairs of blocks for each.
    assert max(rows.values()) <= 16 * len(texts), rows


def test_joined_components(monkeypatch):
    """Links of a group, however its rounds and nearest pairs are cut, against all pairs of sets."""
    draw = np.random.default_rng(9)
    sets = []
    for _ in range(12):
        own = draw.integers(0, 1 << 62, int(draw.integers(5, 90)), dtype=np.uint64)
        for _ in range(7):
            sets.append(np.unique(np.r_[own[draw.random(len(own)) > 0.08], draw.integers(0, 1 << 62, 2, dtype=np.uint64)]))
    sets = [sets[k] for k in draw.permutation(len(sets))]
    comp = draw.integers(0, 60, len(sets))
    comp = np.unique(comp, return_inverse=True)[1]
    want = list(range(int(comp.max()) + 1))
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if common * 100 >= (len(sets[a]) + len(sets[b]) - common) * neardup.SIMILARITY:
                x, y = sorted((want[comp[a]], want[comp[b]]))
                want = [x if v == y else v for v in want]
    ends = np.r_[0, np.cumsum([len(s) for s in sets])]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    for k, size in ((1, 5), (8, 256), (2, 1000)):
        monkeypatch.setattr(neardup, "NEAREST", k)
        monkeypatch.setattr(neardup, "ROUND", size)
        assert neardup._joined(codes, ends, [neardup.parity(s) for s in sets], comp).tolist() == want
    assert 1 < len(set(want)) < len(want)
