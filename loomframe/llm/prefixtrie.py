"""Trie of conversations by their turns: a Cartesian tree over the LCP array of the sorted conversations.

1. Each turn is a 16-byte digest of its role and text, and a conversation is the concatenation of these, cut into pieces of `PIECE` turns. A
   piece is named by its number and by a sum over the digests of all pieces before it, so all pieces that follow one prefix make one
   small trie whose root is that prefix, and conversations of any length are rows of bounded size. Equal pieces are added up
   before anything is sorted.
2. Pieces are sorted by ranges. A task walks its sorted pieces once. The longest common prefixes of neighbours are the LCP array; a node of
   depth d is an interval of pieces between two smaller values, and these intervals nest as the Cartesian tree over the array. A
   stack finds the nearest smaller values on both sides: it holds the intervals still open, each depth once, so boundaries of equal
   LCP are one node, and the depths between a node and its parent in the Cartesian tree are closed with it.
3. Intervals that reach a task's edge leave the task as part of its summary: its first and last piece, its smallest LCP, and what it knows
   of the prefixes of these two. Smallest values are then searched among the tasks' minima: a prefix of the last piece stays open
   until a task whose minimum, or whose LCP with the piece before, is smaller. There is one summary of at most 2 * (`PIECE` + 1)
   entries for each task, so that pass is bounded by the number of tasks; it runs in one task.
4. Sums over subtrees (leaves, saved tokens) that begin in a later piece are needed above it: each node of later pieces is counted for its
   smallest member, and summed from the member's last piece to its first. Only conversations of several pieces take part.
5. A node's members that end there are sorted by ranges and joined to text in parts; the digest reads the parts as a stream.

A node is named by a digest of its prefix; a parent's smallest member is looked up by it, that of parents with many children by
broadcast (a parent has more than 1 / `HUBS` of all nodes as children, so there are fewer than `HUBS`).

Nulls in role and text read as empty; null turns come first, turns of one number are ordered by role, then by the digest of role and text; repeated
rows are turns of their own; rows with a null conv_id take no part. Texts of any length are digested whole. A conversation without turns
is a member of the root. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

PIECE = 64
DIGEST = 16
HUBS = 1024
#: Characters of ids in one part of a node's list.
LIST = 1 << 16


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), tok and chars, with each conversation's turns in order, a long conversation's over several tasks."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("tok").asc()]
    ranged = written(turns.repartitionByRange(F.col("conv_id").asc(), *order).withColumn("part", F.spark_partition_id()), "turns")
    own = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1)
    # Few conversations lie in several tasks: at most one for each edge.
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").select("conv_id", "part", "before")
    placed = own.join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "tok", "chars")


def read_turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return read.select("conv_id", "turn", "role", digest.alias("tok"), F.length("text").cast("long").alias("chars"))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, tok, chars) from numbered turns, and all conv_ids."""
    return turns.select("conv_id", (F.col("at") + 1).alias("depth"), "tok", "chars"), turns.where("at = 0").select("conv_id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As plain(), but the first h = crc32(conv_id) % 6 turns are those of conversation conv_id - conv_id % 100 (SQL's remainder, so -7 leaves -7)."""
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    ids = turns.where("at = 0").select("conv_id")
    heads = turns.where("at < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "at", "tok", "chars")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    taken = ids.select("conv_id", h.alias("h"), base.alias("base")).where("h > 0")
    first = taken.join(heads, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "tok", "chars")
    # Depths of own turns shift only where the base has fewer turns than are wanted.
    short = taken.join(lengths, "base", "left").withColumn("missing", F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).where("missing > 0").select("conv_id", "missing")
    own = turns.where(F.col("at") >= h).join(short, "conv_id", "left").select("conv_id", (F.col("at") + 1 - F.coalesce("missing", F.lit(0))).alias("depth"), "tok", "chars")
    return first.unionByName(own), ids


def pieces(turns: DataFrame, ids: DataFrame, size: int = PIECE) -> DataFrame:
    """conv_id, k, p1, p2, up, seq, chars: each conversation's pieces, the last of them with fewer than `size` turns.

    chars has one entry more than the piece has turns: the first is that of the turn before it (0 for the root).
    """
    k = lambda d: F.floor(d / size).cast("int")
    inside = turns.select("conv_id", k(F.col("depth") - 1).alias("k"), ((F.col("depth") - 1) % size + 1).cast("int").alias("r"), "tok", "chars")
    starts = turns.where(F.col("depth") % size == 0).select("conv_id", k(F.col("depth")).alias("k"), F.lit(0).alias("r"), F.lit(None).cast("binary").alias("tok"), "chars")
    roots = ids.select("conv_id", F.lit(0).alias("k"), F.lit(0).alias("r"), F.lit(None).cast("binary").alias("tok"), F.lit(0).cast("long").alias("chars"))
    rows = inside.unionByName(starts).unionByName(roots).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("r", "tok", "chars"))).alias("x"))  # at most size + 1
    cut = rows.select("conv_id", "k", F.unhex(F.array_join(F.transform(F.filter("x", lambda x: x["r"] > 0), lambda x: F.hex(x["tok"])), "")).alias("seq"), F.col("x.chars").alias("chars"))
    cut = written(cut, "pieces")
    long = (F.col("k") > 0) | (F.length("seq") == size * DIGEST)
    back = Window.partitionBy("conv_id").orderBy("k")
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    named = lambda salt: F.coalesce(F.sum(F.xxhash64(F.lit(salt), "k", "seq").cast("decimal(38,0)")).over(before), F.lit(0).cast("decimal(38,0)")).cast("string")
    several = cut.where(long).withColumns({"p1": named(1), "p2": named(2)})
    several = several.withColumn("up", F.lag(_node("k", "p1", "p2", F.expr(f"substring(seq, 1, {(size - 1) * DIGEST})"))).over(back))
    one = cut.where(~long).withColumns({"p1": F.lit("0"), "p2": F.lit("0"), "up": F.lit(None).cast("binary")})
    return one.unionByName(several)


def _node(k, p1, p2, seq) -> Column:
    return F.unhex(F.md5(F.concat(F.concat_ws(",", F.col(k).cast("string"), p1, p2).cast("binary"), F.lit(b":"), seq)))


def _name(k: int, p1: str, p2: str, seq: bytes) -> bytes:
    return hashlib.md5(f"{k},{p1},{p2}".encode() + b":" + seq).digest()


class Node:
    """What is known of a prefix: members, smallest member, children, and leaves and saved tokens of closed subtrees."""

    __slots__ = ("n", "least", "children", "leaves", "saved")

    def __init__(self, n=0, least=None, children=0, leaves=0, saved=0):
        self.n, self.least, self.children, self.leaves, self.saved = n, least, children, leaves, saved

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def facts(self) -> tuple:
        return self.n, self.least, self.children, self.leaves, self.saved


def common(a: bytes, b: bytes) -> int:
    """Turns that two pieces have in common at their start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * DIGEST] == b[: mid * DIGEST] else (lo, mid - 1)
    return lo


class Piece:
    """A sorted piece with its trie's name."""

    __slots__ = ("k", "p1", "p2", "up", "seq", "chars")

    def __init__(self, k, p1, p2, up, seq, chars):
        self.k, self.p1, self.p2, self.up, self.seq, self.chars = k, p1, p2, up, seq, chars

    def depth(self) -> int:
        return len(self.seq) // DIGEST

    def lcp(self, other: Piece) -> int:
        """-1 if they are of two tries, so that not even the root goes on."""
        return common(self.seq, other.seq) if (self.k, self.p1, self.p2) == (other.k, other.p1, other.p2) else -1

    def row(self, size: int, depth: int, node: Node, saved: int, leaf: int) -> tuple:
        own = _name(self.k, self.p1, self.p2, self.seq[: depth * DIGEST])
        parent = _name(self.k, self.p1, self.p2, self.seq[: (depth - 1) * DIGEST]) if depth else self.up
        return (own, parent, self.k, self.k * size + depth, *node.facts(), saved, leaf)

    def facts(self) -> tuple:
        return tuple(getattr(self, k) for k in self.__slots__)


def _closed(size: int, stack: list[Node], piece: Piece, rows: list[tuple]) -> None:
    """The deepest open prefix of `piece` ends: emit it and add it to its parent."""
    d = len(stack) - 1
    node = stack.pop()
    if d < size:  # else it is the root of the next piece's trie, which emits it
        saved, leaf = (node.n - 1) * piece.chars[d], int(node.children == 0)
        node.leaves, node.saved = node.leaves + leaf, node.saved + saved
        rows.append(piece.row(size, d, node, saved, leaf))
    if d:
        stack[-1].add(node.n, node.least, 1, node.leaves, node.saved)


class Walk:
    """A task's pieces in order. The stack holds the open prefixes of the last piece, one entry a depth."""

    def __init__(self, size: int = PIECE):
        self.size = size
        self.stack: list[Node] = []
        self.first: Piece | None = None
        self.last: Piece | None = None
        self.edge = 0  # so many of the stack's entries are prefixes of the first piece
        self.least = size + 1
        self.left: list[tuple] = []  # closed prefixes of the first piece, deepest first: they may have begun in an earlier task
        self.rows: list[tuple] = []

    def push(self, piece: Piece, n: int, least: int, leaves: int, saved: int) -> None:
        depth = piece.depth()
        if self.first is None:
            self.first, self.edge = piece, depth + 1
        else:
            lcp = self.last.lcp(piece)
            self.least = min(self.least, lcp)
            while len(self.stack) - 1 > lcp:  # the nearest smaller value of these depths is here
                if len(self.stack) == self.edge:
                    self.left.append(self.stack.pop().facts())
                    self.edge -= 1
                else:
                    _closed(self.size, self.stack, self.last, self.rows)
        while len(self.stack) <= depth:
            self.stack.append(Node())
        self.stack[-1].add(n, least, 0, leaves, saved)
        self.last = piece

    def summary(self) -> bytes:
        """First and last piece, smallest LCP, what is known of the first one's prefixes by depth, and of the last one's deeper than that."""
        low = [x.facts() for x in self.stack[: self.edge]] + self.left[::-1]
        return pickle.dumps((self.first.facts(), self.last.facts(), self.least, low, [x.facts() for x in self.stack[self.edge :]]))


def merged(summaries, size: int = PIECE):
    """Nodes that reach a task's edge, from all tasks' summaries in order; yields lists of rows."""
    stack: list[Node] = []
    last, rows = None, []
    for first, end, least, low, high in summaries:
        first, end = Piece(*first), Piece(*end)
        go_on = -1 if last is None else last.lcp(first)
        while len(stack) - 1 > go_on:
            _closed(size, stack, last, rows)
        for d, facts in enumerate(low):
            if d <= go_on:
                stack[d].add(*facts)
            else:
                stack.append(Node(*facts))
        while len(stack) - 1 > least:
            _closed(size, stack, first, rows)
        stack += [Node(*facts) for facts in high]
        last = end
        if len(rows) > 4096:
            yield rows
            rows = []
    while stack:
        _closed(size, stack, last, rows)
    yield rows


_NODE = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("k", pa.int32()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("own_saved", pa.int64()), ("own_leaf", pa.int64()),
    ("part", pa.int32()), ("summary", pa.binary()),
])
_NODE_DDL = "node binary, parent binary, k int, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, own_saved long, own_leaf long, part int, summary binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def trie(cut: DataFrame, size: int = PIECE) -> DataFrame:
    """All nodes of pieces (k, p1, p2, up, seq, chars, conv_id, leaves, saved)."""

    def walk(batches):
        w, part = Walk(size), 0
        for b in batches:
            for k, p1, p2, seq, up, chars, n, least, leaves, saved, part in zip(*[x.to_pylist() for x in b.columns], strict=True):
                w.push(Piece(k, p1, p2, up, seq, chars), n, least, leaves, saved)
            yield _batch([(*r, None, None) for r in w.rows], _NODE)
            w.rows.clear()
        if w.first is not None:
            yield _batch([(*[None] * 11, part, w.summary())], _NODE)

    def merge(batches):
        summaries = (pickle.loads(s) for b in batches for s in b.column(0).to_pylist())
        for rows in merged(summaries, size):
            yield _batch([(*r, None, None) for r in rows], _NODE)

    bounded_batches(cut.sparkSession)
    key = ["k", "p1", "p2", "seq"]
    same = cut.groupBy(*key).agg(F.first("up").alias("up"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    order = [F.col(c).asc() for c in key]
    walked = written(same.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).mapInArrow(walk, _NODE_DDL), "trie")
    # One row for each task that walked.
    edges = walked.where("summary IS NOT NULL").select("summary", "part").coalesce(1).sortWithinPartitions("part").select("summary").mapInArrow(merge, _NODE_DDL)
    return walked.where("summary IS NULL").unionByName(edges).drop("part", "summary")


def with_deeper(cut: DataFrame, size: int = PIECE) -> DataFrame:
    """Add leaves and saved: what the nodes of a conversation's later pieces give, each node counted for its smallest member."""
    long = (F.col("k") > 0) | (F.length("seq") == size * DIGEST)
    none = {"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")}
    own = trie(cut.where("k > 0").withColumns(none), size).groupBy("conv_id", "k").agg(F.sum("own_leaf").alias("_l"), F.sum("own_saved").alias("_s"))
    later = Window.partitionBy("conv_id").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    several = cut.where(long).join(own, ["conv_id", "k"], "left")
    several = several.withColumns({"leaves": F.coalesce(F.sum("_l").over(later), F.lit(0)), "saved": F.coalesce(F.sum("_s").over(later), F.lit(0))}).drop("_l", "_s")
    return cut.where(~long).withColumns(none).unionByName(several)


_EMPTY = hashlib.sha256(b"").hexdigest()


def ends(cut: DataFrame, size: int = PIECE, most: int = LIST) -> DataFrame:
    """node and ends_sha256 of all nodes where a conversation ends."""
    parts_schema = pa.schema([("node", pa.binary()), ("part", pa.int32()), ("no", pa.int64()), ("ids", pa.string())])

    def join(batches):
        node, ids, held, part, no = None, [], 0, 0, 0
        for b in batches:
            rows = []
            for x, conv, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if ids and (x != node or held > most):
                    rows.append((node, part, no, ",".join(ids)))
                    ids, held, no = [], 0, no + 1
                node, part = x, at
                ids.append(str(conv))
                held += len(ids[-1]) + 1
            yield _batch(rows, parts_schema)
        if ids:
            yield _batch([(node, part, no, ",".join(ids))], parts_schema)

    def digest(batches):
        node, state = None, None
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        for b in batches:
            rows = []
            for x, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or x != node:
                    if state is not None:
                        rows.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(rows, schema)
        if state is not None:
            yield _batch([(node, state.hexdigest())], schema)

    order = [F.col("node").asc(), F.col("conv_id").asc()]
    last = cut.where(F.length("seq") < size * DIGEST).select(_node("k", "p1", "p2", "seq").alias("node"), "conv_id")
    listed = last.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "conv_id", F.spark_partition_id().alias("part")).mapInArrow(join, "node binary, part int, no long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "part", "no").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def nodes(turns: DataFrame, ids: DataFrame, size: int = PIECE, most: int = LIST) -> DataFrame:
    """One row for each node of the trie of conversations with these turns (conv_id, depth, tok, chars)."""
    cut = written(pieces(turns, ids, size), "pieces")
    if cut.where("k > 0").isEmpty():
        cut = cut.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    else:
        cut = written(with_deeper(cut, size), "pieces")
    found = written(trie(cut, size), "nodes")
    many = F.col("n_children") > max(64, found.count() // HUBS)
    parents = lambda of: of.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = found.join(F.broadcast(parents(found.where(many)).withColumn("_hot", F.lit(True))), "parent", "left")
    done = hot.where("_hot OR parent IS NULL").drop("_hot")
    rest = hot.where("_hot IS NULL AND parent IS NOT NULL").drop("_hot", "parent_conv_id").join(parents(found.where(~many)), "parent")
    named = done.unionByName(rest).join(ends(cut, size, most), "node", "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, size: int = PIECE, most: int = LIST) -> DataFrame:
    """Nodes of the conversations as they are."""
    return nodes(*plain(numbered(read_turns(conversations))), size, most)


def rebuilt_trie(conversations: DataFrame, size: int = PIECE, most: int = LIST) -> DataFrame:
    """Nodes of the conversations rebuilt on the first turns of others."""
    return nodes(*rebuilt(written(numbered(read_turns(conversations)), "numbered")), size, most)


def sql() -> str:
    """DuckDB SQL for rebuilt_trie()."""
    from .turnrepair import sql_crc32

    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS tok, length(text) AS chars, turn, role FROM t),
nr AS (SELECT conv_id, tok, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tok) - 1 AS pos FROM d),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {sql_crc32("conv_id::VARCHAR")} % 6 AS h FROM d),
turns AS (SELECT ids.conv_id, 0 AS own, pos, tok, chars FROM ids JOIN nr ON nr.conv_id = ids.base AND pos < h UNION ALL SELECT conv_id, 1, pos, tok, chars FROM nr JOIN ids USING (conv_id) WHERE pos >= h),
seqs AS (SELECT ids.conv_id, coalesce(list(tok ORDER BY own, pos) FILTER (tok IS NOT NULL), []) AS toks, coalesce(list(chars ORDER BY own, pos) FILTER (tok IS NOT NULL), []) AS chars FROM ids LEFT JOIN turns USING (conv_id) GROUP BY ids.conv_id),
pre AS (SELECT conv_id, d, toks[1:d] AS p, chars[d] AS chars, d = len(toks) AS ends FROM (SELECT *, unnest(range(0, len(toks) + 1)) AS d FROM seqs)),
nd AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(chars), 0) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nd WHERE d > 0 GROUP BY ALL),
own AS (SELECT nd.*, coalesce(k, 0) AS k, (n - 1) * chars AS saved FROM nd LEFT JOIN kid USING (p, d)),
up AS (SELECT p[1:a] AS p, a AS d, sum((k = 0)::INT)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, parent.conv_id AS parent_conv_id, own.n AS n_convs, own.k AS n_children, up.leaves AS n_leaves, up.saved AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN up USING (p, d) LEFT JOIN nd parent ON parent.d = own.d - 1 AND parent.p = own.p[1:own.d - 1]
"""
