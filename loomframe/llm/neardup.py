"""Near duplicates by minhash with tensored banding, links confirmed on full shingle sets, and connected components.

1. Texts with the same words are one class (their word sequence is hashed); what follows works on one text of each class.
2. A text has two small collections of band keys, LEFT and RIGHT, `BANDS` keys each, of `ROWS` minhashes. A table of the
   tensored scheme is a pair (left key i, right key j): BANDS**2 tables from 2 * BANDS * ROWS minhashes, instead of
   BANDS**2 * 2 * ROWS. A text is paired up only over keys of either collection that at least one other text has.
3. A bucket is a (table, left key, right key). Each of its texts is compared with the bucket's first text on the full sets, and
   links are closed to components.
4. Buckets that still hold several components are open. Many unlike texts can share buckets (a template with a few words filled in),
   so these are not compared with each other: an open text is listed under the rarest fifth of its shingles, and two sets
   with a similarity of 0.8 must meet in a list (of two sets that are so alike, one of the |x| - ceil(0.8 |x|) + 1 rarest of each
   is common). Lists of one text, or of one component, are done; a template's own words are in no list, as they are not rare. The texts
   of a list are dealt into blocks of at most about `TEXTS` texts and `BLOCK` bytes of their parity bitmaps, and a task compares all
   texts of two blocks by these. Texts that a chain of open pairs holds together are a group, which is named by its texts, so it is
   worked on once however many lists it is found in. A task gets a group's full sets, and confirms or refutes each of its pairs that are
   not of one component by then, the nearest ones first. Rows that come out of a step are texts, or links between components that
   were apart, and not pairs, so they don't grow with the square of a group. Nothing is capped.
5. A text's parity bitmap has some bits for each shingle: a bit says whether an odd number of shingles fall on it. Two bitmaps differ in at
   most as many bits as the sets differ in shingles, so pairs that differ in too many are no links; only the others are confirmed on
   the full sets, which are an order of magnitude larger. A long text's bitmap goes to its lists with a quarter of its bits, folded, which
   says less but never too much; the whole bitmap is asked afterwards, pair by pair.

A pair with a similarity of 0.8 is missed by all tables with a probability below 2 * (1 - 0.8 ** ROWS) ** BANDS.

Nulls and texts without words have an empty set, are linked with nothing and are their own component. Repeated rows are exact
copies of each other; rows with a null id are left out of links and keep a null component. Rows that share an id but not their text
are linked through that id, each text with its own set. Texts of any length are hashed whole. Of a component the smallest id is kept.
Empty tables give no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, forget, written

ROWS = 3
BANDS = 12
#: Bytes of bitmaps, and texts, in a block of texts that are compared with all texts of another one.
BLOCK = 1 << 19
TEXTS = 1500
#: Nearest pairs of a text that are confirmed first; its others follow, 16 times as many at a time, if they are still of different components.
NEAREST = 8
#: Texts of a group that are compared with all others before the next ones: bounds the pairs in memory.
ROUND = 256
#: Bits of a bitmap for each hash, at least: the more there are, the closer is its distance to that of the sets.
BITS = 4
#: Bytes of a bitmap that is not shortened where texts are compared in blocks.
SHORT = 64
#: Percent of the union that the intersection must reach.
SIMILARITY = 80

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.cumprod(out, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ with A-Z as a-z."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; all words as one shingle where they are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(w))):
            h = _mix(h * np.uint64(_GOLDEN) + w[k : k + n])
    return np.unique(h)


def text_hash(words: np.ndarray) -> int:
    """A 64-bit hash of a sequence of word hashes."""
    if not len(words):
        return 0
    return int(_mix(np.sum(_mix(words + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(_GOLDEN)), keepdims=True)).view(np.int64)[0])


def signature(s: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """2 * bands keys, the left collection first; each from `rows` minhashes."""
    n = 2 * bands * rows
    seeds = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
    odd = seeds | np.uint64(1)
    low = np.empty(n, np.uint64)
    for k in range(n):
        x = s * odd[k]
        low[k] = np.min(x ^ (x >> np.uint64(32)) * _MIX2)
    keys = np.zeros(2 * bands, np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(_GOLDEN) + low[r::rows])
    return keys


_SIGNED = "doc_id long, text_hash long, n_shingles long, keys array<long>"


def signatures(docs: DataFrame, size: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, a hash of the word sequence, the size of the shingle set, and the band keys (null for an empty set)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            hashes, sizes, keys = [], [], []
            for text in b.column(1).to_pylist():
                w = word_hashes(text)
                s = shingles(text, size)
                hashes.append(text_hash(w))
                sizes.append(len(s))
                keys.append(signature(s, rows, bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNED)


def parity(s: np.ndarray) -> bytes:
    """The parity bitmap of a set of hashes: a power of two of bits, four to eight for each hash and 64 at least."""
    n = max(64, BITS << int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as those of fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size), axis=1)


def brief(bits: bytes) -> bytes:
    """A bitmap with one or two bits for each hash instead of four to eight, but not under SHORT bytes, nor longer than it was."""
    return folded(np.frombuffer(bits, np.uint8)[None], min(len(bits), max(SHORT, len(bits) // BITS))).tobytes()


def text_sets(docs: DataFrame, size: int) -> DataFrame:
    """t, the hash of the word sequence, the full set of shingle hashes of each text, its parity bitmap, and the brief one."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            sets = [shingles(t, size) for t in texts]
            bits = [parity(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([text_hash(word_hashes(t)) for t in texts], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array([brief(b) for b in bits], pa.binary())],
                names=["t", "shingles", "bits", "brief"],
            )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "t long, shingles array<long>, bits binary, brief binary")


def buckets(reps: DataFrame, bands: int = BANDS) -> DataFrame:
    """bucket, t, id and n for every table in which a text shares both its left and its right key with others."""
    keys = reps.select("t", "id", "n", F.posexplode("keys").alias("k", "key"))
    shared = keys.groupBy("k", "key").agg(F.count("*").alias("_c")).where("_c > 1").select("k", "key")
    mine = keys.join(shared, ["k", "key"]).groupBy("t", "id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("ks"))
    left, right = F.filter("ks", lambda x: x["k"] < bands), F.filter("ks", lambda x: x["k"] >= bands)
    pairs = mine.select("t", "id", "n", F.explode(left).alias("l"), right.alias("rs")).select("t", "id", "n", "l", F.explode("rs").alias("r"))
    return pairs.select(F.xxhash64("l.k", "l.key", "r.k", "r.key").alias("bucket"), "t", "id", "n")


def shared_buckets(reps: DataFrame, bands: int = BANDS) -> DataFrame:
    """bucket, t, id and n for every text in a bucket of several, with the bucket's size `c` and its first text `f`."""
    rows = buckets(reps, bands)
    groups = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("id", "t", "n")).alias("f")).where("c > 1")
    return rows.join(groups, "bucket")


def stars(placed: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's first text a and another one b of it (ids ia, ib), whose sizes allow for a link."""
    return placed.where((F.col("t") != F.col("f.t")) & _fits(F.col("n"), F.col("f.n"))).select(F.col("f.t").alias("a"), F.col("t").alias("b"), F.col("f.id").alias("ia"), F.col("id").alias("ib")).distinct()


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than linked sets can differ in shingles."""
    side = lambda c, n: sets.select(F.col("t").alias(c), F.col("bits").alias(f"{n}b"), F.size("shingles").alias(f"{n}n"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "ia", "ib", "xb", "yb", (F.col("xn") + F.col("yn")).alias("n"))

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y, n) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
                x, y = (np.frombuffer(v, np.uint8)[None] for v in (x, y))
                size = min(x.shape[1], y.shape[1])
                keep[i] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * (100 + SIMILARITY) <= n * (100 - SIMILARITY)
            yield b.filter(pa.array(keep)).select([0, 1, 2, 3])

    return both.mapInArrow(run, "a long, b long, ia long, ib long")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), the ids of the pairs whose full sets are similar enough."""
    left = likely(pairs, sets).join(sets.select(F.col("t").alias("a"), F.col("shingles").alias("_x")), "a")
    both = left.join(sets.select(F.col("t").alias("b"), F.col("shingles").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.select("ia", "ib", common.alias("_i"), (F.size("_x") + F.size("_y")).alias("_t")).where(F.col("_i") * 100 >= (F.col("_t") - F.col("_i")) * SIMILARITY).select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct()


#: A hub has more than one in so many of all edges; so there are at most twice as many hubs.
HUBS = 1024


def with_least(edges: DataFrame, own: bool, n: int) -> tuple[DataFrame, DataFrame]:
    """The edges (u, v) with the smallest v of their u (or u itself, if `own` and smaller) as `m`; and the table of u and m.

    Smallest values are found before the shuffle in part. A hub's edges would meet in one task of a join by u, so hubs are
    broadcast: there are at most 2 * HUBS of them, as `n` edges give 2 * n rows and a hub has more than n / HUBS.
    """
    least = F.least(F.col("u"), F.min("v")) if own else F.min("v")
    low = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("c"))
    hub = F.col("c") > max(64, n // HUBS)
    marked = edges.join(F.broadcast(low.where(hub).select("u", F.col("m").alias("h"))), "u", "left")
    hot = marked.where("h IS NOT NULL").select("u", "v", F.col("h").alias("m"))
    cold = marked.where("h IS NULL").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return hot.unionByName(cold), low.select("u", "m")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component): the smallest id that is reachable, for each id that has a link, but for the smallest ids themselves.

    Large-star and small-star rounds in turn: each round hangs neighbours under the smallest known id, and every round's edges are
    written, so the plan does not grow. Ends when a round changes nothing.
    """
    def fingerprint(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, _ = with_least(both, True, before[0])
        large = written(hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        # small star: an id's smaller neighbours, and itself, go under the smallest of them
        hung, least = with_least(large, False, before[0])
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, name)
        forget(edges, large)
        edges, now = after, fingerprint(after)
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def open_texts(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """t, id, n and p, the component, of the texts of buckets that hold several components."""
    rows = placed.where("c > 2").join(comp, "id", "left").select("bucket", "t", "id", "n", F.coalesce("component", "id").alias("p"))
    split = rows.groupBy("bucket").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi").select("bucket")
    return rows.join(split, "bucket").groupBy("t", "id", "n", "p").agg(F.lit(1).alias("_1")).drop("_1")


def rare_lists(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, t, id, n and p: each text under its rarest shingles, as many as two similar sets must share one of.

    Ties in rarity go by the shingle's hash, so that the order is the same for all texts. A list that has the same texts as
    another one, as those of a passage have, is left out.
    """
    each = texts.join(sets.select("t", "shingles"), "t").select("t", "id", "n", "p", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one text is in no list but takes its place among the rarest: what is left of the fifth after those.
    mine = each.join(often, "s").groupBy("t", "id", "n", "p").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100).cast("long") + 1 - (F.col("n") - F.size("x"))
    listed = mine.where(first > 0).select("t", "id", "n", "p", F.explode(F.slice("x", F.lit(1), F.least(first, F.size("x")).cast("int"))).alias("x")).select(F.col("x.s").alias("bucket"), "t", "id", "n", "p")
    facts = listed.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.xxhash64("t").cast("decimal(38,0)")).alias("h"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi")
    return listed.join(facts.groupBy("c", "h").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def blocks(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """g, lo, hi and the texts `m` of two blocks (lo = hi: of one) for all block pairs of a list in which components can meet.

    The texts of a list's largest component have blocks of their own, which are not paired with each other. Lists with more than one in
    `HUBS` of all rows, so fewer than that, are broadcast to their texts; block pairs are dealt by list and blocks, so a list's pairs
    are spread over all tasks. Bitmaps, the brief ones, join last, so they are sent once; until then their bytes are taken as the most
    that they can be for a set's size.
    """
    texts = lists.select(F.col("bucket").alias("g"), "p", "id", "t", "n")
    parts = texts.groupBy("g", "p").agg(F.sum(F.greatest(F.lit(SHORT), F.col("n") / 4)).alias("s"), F.count("*").alias("c"))
    sizes = parts.groupBy("g").agg(F.max_by(F.struct("p", "s", "c"), F.struct("s", "p")).alias("main"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    cut = lambda s, c: F.greatest(F.ceil(s / F.lit(float(BLOCK))), F.ceil(c / F.lit(float(TEXTS))), F.lit(1)).cast("int")
    n_main, n_rest = cut(F.col("main.s"), F.col("main.c")), cut(F.col("s") - F.col("main.s"), F.col("c") - F.col("main.c"))
    about = sizes.select("g", "c", F.struct(F.col("main.p").alias("main"), n_main.alias("k"), n_rest.alias("r")).alias("d"))
    large = F.col("c") > max(64, lists.count() // HUBS)
    marked = texts.join(F.broadcast(about.where(large).select("g", "d")), "g", "left")
    dealt = marked.where("d IS NOT NULL").unionByName(marked.where("d IS NULL").drop("d").join(about.where(~large).select("g", "d"), "g")).select("g", "p", "id", "t", "n", "d.*")
    is_main = F.col("p") == F.col("main")
    block = F.when(is_main, F.pmod(F.xxhash64("t"), "k")).otherwise(F.col("k") + F.pmod(F.xxhash64("t"), "r")).cast("int")
    other = F.when(is_main, F.sequence(F.col("k"), F.col("k") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") + F.col("r") - 1))
    sent = dealt.select("g", "p", "id", "t", "n", block.alias("b"), F.explode(other).alias("o"))
    pairs = sent.join(sets.select("t", F.col("brief").alias("bits")), "t").select("g", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.struct("id", "t", "p", "b", "n", "bits").alias("x"))
    return pairs.repartition("g", "lo", "hi").groupBy("g", "lo", "hi").agg(F.collect_list("x").alias("m"))


def _near(bits: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a text of `left` and one of `right` whose bitmaps and sizes allow for a link, and how far the bitmaps are apart."""
    sizes = np.array([len(b) for b in bits])
    found = [(np.zeros(0, np.int64),) * 3]
    for size in np.unique(sizes[right]):
        these = right[sizes[right] == size]
        own = np.frombuffer(b"".join(bits[k] for k in these), np.uint8).reshape(len(these), size)
        for i in left:
            small = min(size, sizes[i])
            if max(size, sizes[i]) > 2 * small:  # too unlike in size
                continue
            x = folded(np.frombuffer(bits[i], np.uint8)[None], small)
            differ = np.bitwise_count((own if small == size else folded(own, small)) ^ x).sum(axis=1, dtype=np.int64)
            fits = (differ * (100 + SIMILARITY) <= (n[these] + n[i]) * (100 - SIMILARITY)) & (np.minimum(n[these], n[i]) * 100 >= np.maximum(n[these], n[i]) * SIMILARITY)
            at = these[fits]
            found.append((np.full(len(at), i), at, differ[fits]))
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, far


def _nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """Which pairs are among the k nearest of either of their texts, and whether a text has more of them."""
    keep, more = np.zeros(len(i), bool), False
    for own, other in ((i, j), (j, i)):
        order = np.lexsort((other, far, own))
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0]) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
        keep[order[rank < k]] = True
        more |= bool((rank >= k).any())
    return keep, more


def _chained(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (of each text a smallest one of those it is known to belong with) after texts i and j were brought together, pair by pair."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def near_groups(paired: DataFrame) -> DataFrame:
    """h, t and p: the texts of two blocks that chains of pairs of different components, which may be links by their bitmaps, hold together.

    h is a hash of such a group's texts, so a group that is found in many lists is one. A text is named once for two blocks, however many
    pairs it has, so there are no more rows than were sent to be compared.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi, members = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].values
                texts, comp, block, n = (members.field(i).to_numpy() for i in range(1, 5))
                left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
                if not len(left) or not len(right) or len(np.unique(comp)) < 2:
                    continue
                bits, label, open_ = members.field(5).to_pylist(), np.arange(len(texts)), np.zeros(len(texts), bool)
                for start in range(0, len(left), ROUND):
                    i, j, _ = _near(bits, n, left[start : start + ROUND], right)
                    good = comp[i] != comp[j]
                    i, j = i[good], j[good]
                    label = _chained(label, i, j)
                    open_[i] = open_[j] = True
                named = np.flatnonzero(open_)
                sums = np.zeros(len(texts), np.uint64)
                np.add.at(sums, label[named], _mix(texts[named].view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(sums[label[named]].view(np.int64)), pa.array(texts[named]), pa.array(comp[named])], names=["h", "t", "p"])

    return paired.select("lo", "hi", "m").mapInArrow(run, "h long, t long, p long").distinct()


def finer_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups of near_groups(), told apart by whole bitmaps before their sets, an order of magnitude larger, are sent."""
    whole = sets.select("t", F.size("shingles").cast("long").alias("n"), "bits")
    x = F.struct(F.lit(0).cast("long").alias("id"), "t", "p", F.lit(0).alias("b"), "n", "bits")
    held = groups.join(whole, "t").select("h", x.alias("x")).repartition("h").groupBy("h").agg(F.collect_list("x").alias("m"))
    return near_groups(held.select(F.lit(0).alias("lo"), F.lit(0).alias("hi"), "m"))


def _similar(codes: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sets of texts i and j, pair by pair, are similar enough; text k's set is codes[ends[k] : ends[k + 1]], small numbers."""
    out, inside = np.zeros(len(i), bool), np.zeros(int(codes.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else ():
        own = codes[ends[i[at[0]]] : ends[i[at[0]] + 1]]
        sizes = ends[j[at] + 1] - ends[j[at]]
        inside[own] = True
        hits = inside[np.concatenate([codes[ends[k] : ends[k + 1]] for k in j[at]])]
        inside[own] = False
        common = np.add.reduceat(hits, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
        out[at] = common * 100 >= (len(own) + sizes - common) * SIMILARITY
    return out


def _joined(codes: np.ndarray, ends: np.ndarray, bits: list[bytes], comp: np.ndarray) -> np.ndarray:
    """For each component (a number in `comp`) of a group's texts, the smallest one that links lead to."""
    n, every, label = np.diff(ends), np.arange(len(comp)), np.arange(int(comp.max()) + 1)
    for start in range(0, len(comp), ROUND):
        i, j, far = _near(bits, n, every[start : start + ROUND], every[start:])
        apart, k = (i < j) & (label[comp[i]] != label[comp[j]]), NEAREST
        i, j, far = i[apart], j[apart], far[apart]
        # Where texts are much alike, most become one component by their nearest pairs, so the others need not be looked at.
        while len(i):
            keep, _ = _nearest(i, j, far, k)
            linked = _similar(codes, ends, i[keep], j[keep])
            label = _chained(label, comp[i[keep][linked]], comp[j[keep][linked]])
            rest = ~keep & (label[comp[i]] != label[comp[j]])
            i, j, far, k = i[rest], j[rest], far[rest], 16 * k
    return label


def group_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components of a group (by their ids) which links between full sets lead from one to the other, the smallest one being b.

    All pairs of a group are confirmed, refuted or of one component by then; of their links only those between components come out, fewer
    than the group has texts.
    """
    held = groups.join(sets.select("t", "shingles"), "t").select("h", F.struct("p", "shingles").alias("x")).repartition("h").groupBy("h").agg(F.collect_list("x").alias("m"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column(0)[row].values
                ids, comp = np.unique(members.field(0).to_numpy(), return_inverse=True)
                lists = members.field(1)
                ends = lists.offsets.to_numpy().astype(np.int64)
                hashes = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
                ends = ends - ends[0]
                bits = [parity(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                label = _joined(np.unique(hashes, return_inverse=True)[1], ends, bits, comp)
                hung = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(ids[label[hung]])], names=["a", "b"])

    return held.select("m").mapInArrow(run, "a long, b long").distinct()


def same_ids(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): an id of several texts with the id that stands for each of them."""
    several = signed.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo < hi").select("doc_id")
    texts = signed.join(several, "doc_id").select("doc_id", F.col("text_hash").alias("t")).distinct()
    return texts.join(reps.select("t", "id"), "t").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def classes(docs: DataFrame, size: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles and component_id for each row."""
    signed = written(signatures(docs, size, rows, bands), "signed")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(real.groupBy("text_hash").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min_by("keys", "doc_id").alias("keys")).withColumnRenamed("text_hash", "t"), "reps")
    placed = written(shared_buckets(reps, bands), "buckets")
    # The full set of one row of each text that has a bucket, found by its id; an id's other texts come along and are left out by their hash.
    wanted = placed.select(F.col("id").alias("doc_id")).distinct()
    sets = written(text_sets(docs.join(wanted, "doc_id", "left_semi"), size).join(placed.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.first("brief").alias("brief")), "sets")
    links = written(confirm(stars(placed), sets).unionByName(same_ids(real, reps)), "links")
    comp = components(links)
    opened = written(open_texts(placed, comp), "open")
    if not opened.isEmpty():
        lists = written(rare_lists(opened, sets), "lists")
        groups = written(near_groups(blocks(sets, lists)), "groups")
        groups = written(finer_groups(groups, sets), "groups")
        more = written(group_links(groups, sets), "links")
        if not more.isEmpty():
            comp = components(links.union(more))
    member = reps.select(F.col("t").alias("text_hash"), "id").join(comp, "id", "left").select("text_hash", F.coalesce("component", "id").alias("_component"))
    named = signed.select("doc_id", "text_hash", "n_shingles").join(member, "text_hash", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))


def mark(docs: DataFrame, size: int = 5) -> DataFrame:
    """classes() and `kept`: whether the row's id is its component's."""
    return classes(docs, size).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component, with all its columns; rows with a null id stay. Of rows that repeat the kept id, one stays."""
    kept = mark(docs, size).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_n_id")).distinct()
    named = docs.join(kept, docs["doc_id"].cast("long") == kept["_n_id"], "left_semi")
    single = named.dropDuplicates(["doc_id"])
    return single.unionByName(docs.where(docs["doc_id"].isNull()))
