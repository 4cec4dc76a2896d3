"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

1. Tokenize each text once; cut it at multiples of the sequence length. All pieces but a document's last are full.
2. Count pieces by length (at most `max_len` rows, whatever the corpus) and place lengths longest first: each goes to
   the pack pattern with the most room, and pattern counts are split instead of looking at single documents. Where none has
   room, new packs take as many pieces of that length as they hold.
3. Number the pieces of each length (rank) and look the rank up among the pattern slots of that length.

Step 2 runs on the driver over at most `max_len` numbers. Ranks are numbered within (length, hash chunk) with an offset
for each chunk, so that a length shared by a third of all documents is spread over many tasks; a length of n pieces has about the
square root of n chunks, so neither a chunk nor the list of a length's chunks is large.

A sequence is padded to `max_len`; one that is filled to a power of two can be stored at that size as it is.

Nulls: a null text is an empty one (a single end token). Repeated rows and repeated ids each give pieces of their own.
An empty table gives no rows. Texts of any length are cut into as many pieces as they need; ties in length are packed in the order of
their columns. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written
from .wordbpe import default_path, encoder

MAX_LEN = 2048
END_ID = 1
#: Fewest pieces numbered together; a length with more pieces is numbered in several chunks.
RANK_CHUNK = 500

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids into pieces of at most `max_len` ids."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    end = int(end_id).to_bytes(4, "little")
    step = 4 * max_len

    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, value in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def pack_histogram(histogram: dict[int, int], max_len: int = MAX_LEN) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack lengths; gives slots (length, first rank, how many, first sequence, offset) and the number of sequences.

    A pattern is a chain (length, offset, chain before it) that `count` sequences share.
    """
    open_packs: list[tuple[int, int, int, tuple]] = []  # (-room, order, count, chain)
    done: list[tuple[int, tuple]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            copies = 1
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, chain = heapq.heappop(open_packs)
                room = -room
            else:  # new packs, each with as many of this length as it holds, so that a length shared by very many is not spread
                copies = min(left, max_len // length)
                room, count, chain = max_len, left // copies, ()
            used = min(left // copies, count)
            order += 1
            if count > used:
                heapq.heappush(open_packs, (-room, order, count - used, chain))
            order += 1
            grown = chain
            for _ in range(copies):
                grown = (length, max_len - room, grown)
                room -= length
            if room:
                heapq.heappush(open_packs, (-room, order, used, grown))
            else:
                done.append((used, grown))
            left -= used * copies
    done += [(count, chain) for _, _, count, chain in sorted(open_packs)]
    next_rank: dict[int, int] = {}
    slots, sequence = [], 0
    for count, chain in done:
        while chain:
            length, offset, chain = chain
            rank = next_rank.get(length, 0)
            slots.append((length, rank, count, sequence, offset))
            next_rank[length] = rank + count
        sequence += count
    return slots, sequence


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add sequence_id and offset to rows that have a `length` between 1 and `max_len`.

    `pieces` is read twice and should be a written table. The histogram has at most `max_len` rows; the slot table grows with
    the patterns found in it, not with the corpus.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if any(n < 1 or n > max_len for n in counts):
        raise ValueError(f"lengths must be from 1 to {max_len}")
    slots, _ = pack_histogram(counts, max_len)
    grouped: dict[int, list] = {}
    for length, *rest in slots:
        grouped.setdefault(length, []).append(tuple(rest))
    by_length = {n: [np.array(c, dtype=np.int64) for c in zip(*sorted(own), strict=True)] for n, own in grouped.items()}

    # Chunks of a length: its number of pieces is known from the histogram, which holds at most max_len entries.
    chunks = F.create_map(*[x for n, c in sorted(counts.items()) for x in (F.lit(n), F.lit(-(-c // max(RANK_CHUNK, math.isqrt(c)))))]) if counts else F.create_map(F.lit(0), F.lit(1))
    columns = pieces.columns
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*columns), F.element_at(chunks, F.col("length").cast("int"))))
    first = (
        dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*columns)) - 1)
        .join(first, ["length", "_chunk"])
        .select(*columns, (F.col("_before") + F.col("_rank")).alias("_rank"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def placed(batches):
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            at = np.argsort(lengths, kind="stable")
            for group in np.split(at, np.flatnonzero(np.diff(lengths[at])) + 1) if len(at) else []:
                starts, _, sequences, offsets = by_length[int(lengths[group[0]])]
                k = np.searchsorted(starts, ranks[group], side="right") - 1
                sequence[group] = sequences[k] + ranks[group] - starts[k]
                offset[group] = offsets[k]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """One row for each piece of each document, with its place: sequence_id and offset."""
    return pack(written(token_pieces(docs, path, max_len), "pieces"), max_len)
