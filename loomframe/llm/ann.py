"""Approximate nearest neighbours: NN-descent builds a neighbour graph by iterative joins, queries search it greedily.

Graph. Rows with equal vectors are one node. Nodes start with neighbours from `TABLES` random-hyperplane tables, whose buckets are
dealt into parts of about `PART` nodes. Then, `ROUNDS` times or until few edges change, every node's neighbours and the nodes that
have it as a neighbour are gathered by a join with the vectors; nodes that stand in one list, being neighbours of a neighbour, are
compared, and each node keeps its `K` nearest. A list passes on each member's `K` nearest in it, which loses nothing, as a member keeps
no more. All nodes that have a node as a neighbour take part: where they are more than `REVERSE`, they are dealt into several lists
of that node. Pairs compared in an earlier round are not compared again.
Graph and search carry vectors as 16-bit shares of the row's own largest component, so no row affects another's precision, and measure
them in double precision.

Search. A query starts at the nearest `ENTRIES` of `PIVOTS` sampled nodes (a fixed number, so a bounded size) and, if its own vector
is a node, at that one. In each round all nodes of its beam that were not looked at are expanded: a join gives their neighbours, a
second one their vectors, and the `BEAM` nearest stay. It ends when no beam has anything to expand; every round is written to the
shared folder. The beam's nearest `RERANK` nodes, and all that tie with the last of them, are measured again on the original
vectors in double precision. The search graph has each node's `K` neighbours and the `REVERSE` nearest that have it as one.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Every other row is a
candidate, also where ids repeat: such rows count one each, and each is a query of its own. Distances are only defined between vectors
of one length, so each length has a graph and search of its own. Ties in distance go to the smaller id. Empty tables give no rows;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, forget, written

K = 32
REVERSE = 32
#: New neighbours of a node that take part in a round.
FRESH = 12
ROUNDS = 4
#: Rounds end early when fewer than this share of the edges is new.
CHANGED = 0.03
TABLES = 6
PART = 48
PIVOTS = 1024
ENTRIES = 32
BEAM = 256
RERANK = 48


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    vector = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return read.where(~bad & F.exists("vector", lambda x: x != 0))


def nodes_of(vectors: DataFrame, most: int) -> DataFrame:
    """One row for each different vector (to be written, which fixes the ids): id, vector, and its `most` smallest vec_ids, repeated ones as often, in `members`."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = vectors.withColumn("_r", rank).where(F.col("_r") <= most)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("id", F.monotonically_increasing_id())


def _matrix(column: pa.Array) -> np.ndarray:
    """Codes as the rows of a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, 4:]).view("<i2") * np.ascontiguousarray(raw[:, :4]).view("<f4").astype(np.float64)


def coded(nodes: DataFrame) -> DataFrame:
    """id and code: a row's scale in single precision, and its components as 16-bit shares of it."""

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64) if b.num_rows else np.zeros((0, 1))
            top = np.abs(x).max(axis=1, keepdims=True) / 32767 if len(x) else x
            scale = np.clip(top, 1e-30, 1e30).astype("<f4")  # squares stay finite
            whole = np.concatenate([scale.view(np.uint8), np.clip(np.rint(x / scale), -32767, 32767).astype("<i2").view(np.uint8)], axis=1) if len(x) else x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in whole], pa.binary())], names=["id", "code"])

    return nodes.select("id", "vector").mapInArrow(run, "id long, code binary")


def _compare(members: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(v, u, d): for the lists that rows (keys, u, new, most, code) with equal keys form, each u's `k` nearest partners in it nearer than `most`, unless both are old."""
    kinds = ((pa.int64(), np.int64), (pa.int64(), np.int64), (pa.float64(), np.float64))

    def work(rows: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        u, new, most = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("u", "new", "most"))
        codes = _matrix(rows.column("code"))
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            order = np.lexsort((~new[lo:hi], u[lo:hi])) + lo
            order = order[np.r_[True, np.diff(u[order]) != 0]]
            fresh = new[order]
            if len(order) < 2 or not fresh.any():
                continue
            x = codes[order]
            x -= x[0]  # lists are local; a common offset would cost digits
            norm = np.einsum("ij,ij->i", x, x)
            d = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
            np.fill_diagonal(d, np.inf)
            d[~fresh[:, None] & ~fresh[None, :]] = np.inf
            d[d >= most[order][:, None]] = np.inf
            if len(order) > k:
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                d = np.take_along_axis(d, near, axis=1)
            else:
                near = np.broadcast_to(np.arange(len(order)), d.shape)
            i, j = np.nonzero(np.isfinite(d))
            for column, value in zip(out, (u[order[i]], u[order[near[i, j]]], d[i, j]), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]), kind) for c, (kind, t) in zip(out, kinds, strict=True)], names=["v", "u", "d"])

    def run(batches):
        held = None  # rows of the list that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.concat_batches([held, b]) if held is not None else b
            at = [rows.column(c).to_numpy(zero_copy_only=False) for c in keys]
            cuts = np.r_[0, np.flatnonzero(np.any([np.diff(x) != 0 for x in at], axis=0)) + 1]
            yield work(rows, cuts)
            held = rows.slice(int(cuts[-1]))
        if held is not None:
            yield work(held, np.array([0, held.num_rows]))

    dealt = members.select(*keys, "u", "new", "most", "code").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "v long, u long, d double")


def _nearest(edges: DataFrame, k: int, by: str = "v", other: str = "u") -> DataFrame:
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("d", other))).where(F.col("_r") <= k).drop("_r")


def _first_edges(codes: DataFrame, n: int, dim: int, k: int, seed: int) -> DataFrame:
    """Neighbours within the parts of the buckets of random-hyperplane tables."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / PART))))
    planes = np.random.default_rng(seed).standard_normal((TABLES, dim, bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            for t in range(TABLES if len(x) else 0):
                keys = (x @ planes[t] > 0) @ weights if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(keys, pa.int64()), b.column(0), b.column(1)], names=["t", "bucket", "id", "code"])

    placed = codes.select("id", "code").mapInArrow(run, "t int, bucket long, id long, code binary")
    counts = placed.groupBy("t", "bucket").agg(F.count("*").alias("_c"))
    part = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("_c") / F.lit(float(PART))))
    members = placed.join(counts, ["t", "bucket"]).select("t", "bucket", part.alias("p"), F.col("id").alias("u"), F.lit(True).alias("new"), F.lit(float("inf")).alias("most"), "code")
    found = _compare(members, ["t", "bucket", "p"], k).groupBy("v", "u").agg(F.min("d").alias("d"))
    return _nearest(found, k).withColumn("new", F.lit(True))


def build(codes: DataFrame, n: int, dim: int, k: int = K, reverse: int = REVERSE, rounds: int = ROUNDS, fresh: int = FRESH, seed: int = 1) -> DataFrame:
    """NN-descent: edges (v, u, d, new), the `k` nearest neighbours found for every node. `codes` is a written table."""
    edges = written(_first_edges(codes, n, dim, k, seed), "edges")
    for _ in range(rounds):
        # Of the new neighbours the nearest `fresh` take part in this round, the others stay new for a later one.
        turn = F.row_number().over(Window.partitionBy("v", "new").orderBy("d", "u"))
        ranked = written(edges.withColumn("now", ~F.col("new") | (turn <= fresh)), "edges")
        active = ranked.where("now")
        parts = active.groupBy(F.col("u").alias("v")).agg(F.ceil(F.count("*") / F.lit(float(reverse))).alias("_p"))
        back = active.select(F.col("u").alias("v"), F.col("v").alias("u"), "new").join(parts.where("_p > 1"), "v", "left")
        back = back.select("v", "u", "new", F.pmod(F.xxhash64("u"), F.coalesce("_p", F.lit(1))).alias("p"))
        ahead = active.select("v", "u", "new").join(parts.where("_p > 1"), "v", "left").select("v", "u", "new", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_p", F.lit(1)) - 1)).alias("p"))
        full = edges.groupBy("v").agg(F.count("*").alias("_c"), F.max("d").alias("_d")).where(F.col("_c") >= k).select(F.col("v").alias("u"), F.col("_d"))
        known = codes.withColumnRenamed("id", "u").join(full, "u", "left").select("u", F.coalesce("_d", F.lit(float("inf"))).alias("most"), "code")
        members = ahead.union(back).join(known, "u")
        proposed = _compare(members, ["v", "p"], k).select("v", "u", "d", F.lit(True).alias("new"))
        all_ = ranked.select("v", "u", "d", (F.col("new") & ~F.col("now")).alias("new")).union(proposed).groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        after = written(_nearest(all_, k), "edges")
        forget(edges, ranked)
        edges = after
        changed = edges.agg(F.avg(F.col("new").cast("double"))).first()[0]
        if changed is None or changed < CHANGED:
            break
    return edges


def adjacency(edges: DataFrame, reverse: int = REVERSE) -> DataFrame:
    """node and `to`: its neighbours and at most `reverse` nodes that have it as one."""
    back = _nearest(edges, reverse, "u", "v").select(F.col("u").alias("node"), F.col("v").alias("u"))
    return edges.select(F.col("v").alias("node"), "u").union(back).groupBy("node").agg(F.collect_set("u").alias("to"))


_STATE = "q long, beam array<struct<d:double,id:long,done:boolean>>, todo array<long>"
_BEAM = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("done", pa.bool_())]))


def _batch(q: list, beams: list) -> pa.RecordBatch:
    """beams: (d, id, done) sorted by d; everything not done is to be expanded now and so done afterwards."""
    todo = [i[~done].tolist() for _, i, done in beams]
    flat = [np.concatenate([np.zeros(0, t), *[b[k] for b in beams]]) for k, t in enumerate((np.float64, np.int64, bool))]
    ends = np.cumsum([0, *[len(b[0]) for b in beams]])
    fields = [pa.array(flat[0], pa.float64()), pa.array(flat[1], pa.int64()), pa.array(np.ones(len(flat[2]), bool))]
    beam = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_BEAM.value_type)))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), beam, pa.array(todo, pa.list_(pa.int64()))], names=["q", "beam", "todo"])


def _measured(pairs: DataFrame) -> DataFrame:
    """q, u and their squared distance d, from rows with both codes."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2)) - _matrix(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, x))], names=["q", "u", "d"])

    return pairs.select("q", "u", "code", "qcode").mapInArrow(run, "q long, u long, d double")


def search(queries: DataFrame, codes: DataFrame, links: DataFrame, beam: int = BEAM, entries: int = ENTRIES, pivots: int = PIVOTS) -> DataFrame:
    """q and its beam, for queries (q, qcode, own: a node to start at as well, or null). All three are written tables.

    Only ids go with the beams; a node's code meets the query's where they are measured, and nothing but the distance goes on.
    """
    start = codes.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()  # bounded by `pivots`
    ids, table = start["id"].to_numpy(), _matrix(start["code"])

    def begin(batches):
        for b in batches:
            beams = []
            for code, own in zip(_matrix(b.column(1)), b.column(2).to_pylist(), strict=True):
                d = ((table - code) ** 2).sum(axis=1)
                near = np.lexsort((ids, d))[:entries]
                i, dd = ids[near], d[near]
                if own is not None:
                    dd, i = np.r_[0, dd[i != own]].astype(np.float64), np.r_[own, i[i != own]]
                beams.append((dd, i, np.zeros(len(i), bool)))
            yield _batch(b.column(0).to_pylist(), beams)

    def merge(batches):
        for b in batches:
            beams = []
            for row in range(b.num_rows):
                old, found = b.column(1)[row].values, b.column(2)[row].values
                i, d, done = old.field(1).to_numpy(), old.field(0).to_numpy(), old.field(2).to_numpy(zero_copy_only=False)
                if found is not None and len(found):
                    new = found.field(1).to_numpy()
                    at = np.flatnonzero(~np.isin(new, i))
                    i, d, done = np.r_[i, new[at]], np.r_[d, found.field(0).to_numpy()[at]], np.r_[done, np.zeros(len(at), bool)]
                near = np.lexsort((i, d))[:beam]
                beams.append((d[near], i[near], done[near]))
            yield _batch(b.column(0).to_pylist(), beams)

    state = written(queries.select("q", "qcode", "own").mapInArrow(begin, _STATE), "beams")
    asking, vectors = queries.select("q", "qcode"), codes.withColumnRenamed("id", "u")
    while not state.where(F.size("todo") > 0).isEmpty():
        front = state.select("q", F.explode("todo").alias("node"))
        pairs = front.join(links, "node").select("q", F.explode("to").alias("u")).distinct()
        near = _measured(pairs.join(vectors, "u").join(asking, "q"))
        found = near.groupBy("q").agg(F.collect_list(F.struct("d", "u")).alias("found"))  # at most beam * (k + reverse)
        after = written(state.select("q", "beam").join(found, "q", "left").mapInArrow(merge, _STATE), "beams")
        forget(state)
        state = after
    return state.select("q", "beam")


def _exact(pairs: DataFrame) -> DataFrame:
    """q, id and score: the Euclidean distance of the vectors x and y in double precision."""

    def run(batches):
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)) if b.num_rows else np.zeros(0))], names=["q", "id", "score"])

    return pairs.select("q", "id", "x", "y").mapInArrow(run, "q long, id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: for each row where `is_query` (of vec_id) holds, its `k` nearest other rows found."""
    bounded_batches(rows.sparkSession)
    vectors = written(usable(rows), "vectors")
    dims = [r["n"] for r in vectors.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]  # the different lengths
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_nearest_of_length(vectors.where(F.size("vector") == n), n, is_query, k) for n in dims])


def _nearest_of_length(vectors: DataFrame, dim: int, is_query: Column, k: int) -> DataFrame:
    nodes = written(nodes_of(vectors, k + 1), "nodes")
    codes = written(coded(nodes), "codes")
    links = written(adjacency(build(codes, nodes.count(), dim)), "links")
    asked = written(vectors.where(is_query).join(nodes.select("vector", "id"), "vector").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "asked")
    queries = written(asked.select("q").distinct().join(codes.select(F.col("id").alias("q"), F.col("code").alias("qcode")), "q").withColumn("own", F.col("q")), "queries")
    beams = search(queries, codes, links)
    near = beams.select("q", F.explode(F.filter("beam", lambda x, i: (i < RERANK) | (x["d"] <= F.get("beam", F.lit(RERANK - 1))["d"]))).alias("b")).select("q", F.col("b.id").alias("id"))
    own = nodes.select("id", "vector")
    pairs = near.join(own.select(F.col("id").alias("q"), F.col("vector").alias("x")), "q").join(own.select("id", F.col("vector").alias("y")), "id")
    scored = _exact(pairs).join(nodes.select("id", "members"), "id").select("q", "score", (F.col("id") == F.col("q")).alias("same"), F.posexplode("members").alias("at", "vec_id"))
    best = _ranked(scored, ["q"], k + 1, "at").drop("rank")  # one more, as the query's own row goes; the same for all queries of a node
    # Of the rows with the query's vector and id the first one is its own.
    first = F.row_number().over(Window.partitionBy("row", "vec_id", "same").orderBy("at"))
    answers = asked.join(best, "q").withColumn("_first", first).where(~(F.col("same") & (F.col("query_id") == F.col("vec_id")) & (F.col("_first") == 1)))
    return _ranked(answers, ["row"], k, "at").select("query_id", "rank", "vec_id", "score")


def _ranked(rows: DataFrame, by: list[str], k: int, last: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "vec_id", last))).where(F.col("rank") <= k)
