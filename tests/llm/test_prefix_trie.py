"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest

from loomframe.llm import prefixtrie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, seq int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def in_order(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn, role or "", text or ""))
    tok = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: [r[1:] for r in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), tok(r)))] for c, own in out.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(p))))
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def drawn(seed, convs, most, kinds):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(draw.randint(1, most)):
            rows.append((c if draw.random() > 0.01 else None, t if draw.random() > 0.1 else None, draw.choice(["user", "assistant", None, ""]), draw.choice(kinds)))
    return rows + draw.sample(rows, min(len(rows), 10)) + [(1000, 0, "user", "x" * 5000), (-7, 1, "u", "b")]


KINDS = ["a", "b", "ab", None, "", "\U0001f600é"]


@pytest.mark.parametrize(("piece", "partitions"), [(64, "8"), (3, "13"), (1, "5")])
def test_against_prefixes(spark, monkeypatch, piece, partitions):
    monkeypatch.setattr(T, "HUBS", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = drawn(piece, 150, 9, KINDS)
        assert got(T.conversation_trie(frame(spark, rows), piece, 5)) == plain(in_order(rows))
        assert got(T.rebuilt_trie(frame(spark, rows), piece, 5)) == plain(rebuild(in_order(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversations_and_copies(spark):
    draw = random.Random(4)
    trunk = [draw.choice("pqrs") for _ in range(200)]
    rows = []
    for c in range(12):  # they part at different depths, some at the edge of a piece
        cut = [200, 64, 128, 63, 65, 199][c % 6]
        rows += [(c, t, "user", trunk[t] if t < cut else f"{c % 5}{t}") for t in range(cut + (0 if c % 4 == 0 else 70))]
    rows += [(500 + c, t, "user", "copy") for c in range(300) for t in range(3)]
    assert got(T.conversation_trie(frame(spark, rows))) == plain(in_order(rows))


def test_standard_tables_and_sql(spark, sf, tmp_path):
    for rows in ([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], drawn(9, 60, 7, KINDS)):
        want = plain(rebuild(in_order(rows)))
        assert got(T.rebuilt_trie(frame(spark, rows))) == want
        at = f"{tmp_path}/{len(rows)}"
        frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(at)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{at}/*.parquet'")
        names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
        assert sorted(con.sql(f"SELECT {names} FROM ({T.sql()})").fetchall(), key=lambda r: r[:2]) == want


def test_empty(spark):
    assert T.rebuilt_trie(frame(spark, [])).count() == 0
    assert T.rebuilt_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_summaries_of_any_cut():
    """The walk in any number of tasks gives the nodes of the walk in one."""
    draw = random.Random(6)
    seqs = sorted({b"".join(bytes([draw.randint(0, 2)]) * T.DIGEST for _ in range(draw.randint(0, 6))) for _ in range(120)})
    pieces = [T.Piece(draw.choice([0]), "0", "0", None, s, [0] + [1 + s[i * T.DIGEST] for i in range(len(s) // T.DIGEST)]) for s in seqs]

    def run(cuts):
        rows, summaries = [], []
        for a, b in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
            w = T.Walk()
            for i in range(a, b):
                w.push(pieces[i], 1 + i % 3, i, 0, 0)
            if b > a:
                summaries.append(w.summary())
                rows += w.rows
        for more in T.merged(map(T.pickle.loads, summaries)):
            rows += more
        return sorted(rows)

    want = run([])
    for _ in range(60):
        assert run(sorted(draw.choices(range(len(pieces) + 1), k=draw.randint(1, 40)))) == want
