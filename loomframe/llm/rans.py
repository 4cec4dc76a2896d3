"""Token ids in compressed segments: a static range asymmetric numeral system, interleaved, with checkpoints and checksums.

Layout of a segment (one row of the written table; all integers little-endian):

    magic "LFR1" | uint32 length of the header | header (JSON) | sections, in the order and with the sizes the header lists

* `symbols`, `freqs`: the frequency table, which all blocks of the segment share; frequencies sum to 2**PRECISION.
* `docs`, `sizes`: ids of the documents and their numbers of tokens, in order.
* blocks: up to BLOCK tokens each, decodable alone. Token i of a block belongs to lane i mod LANES. A block has its words
  (uint32, one stream for its lanes in the order a decoder asks for them) and checkpoints: every STRIDE steps the lanes'
  states and the place in the words, so that a block can be entered there as well.
* `crc`: CRC-32 of every block's ids as uint32; the header has a CRC-32 of all sections together.

Lanes of all blocks are coded side by side in numpy. A lane's state x is kept in [2**31, 2**63): before a symbol of
frequency f is put in, one 32-bit word leaves if x >= f << (63 - PRECISION); decoding takes it back.

Nulls: a null text is an empty one (only the end id); a null id comes first. Rows with equal ids are ordered by a hash of their text, then by
it; texts of any length are encoded whole.
An empty table gives an empty file table. Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written
from .wordbpe import default_path, encoder

PRECISION = 20
LANES = 64
BLOCK = 1 << 16
STRIDE = 512
#: A segment is closed once it has this many tokens.
SEGMENT = 1 << 21
END_ID = 1
#: Words that a worker remembers; more than elsewhere, as this operator also has the coding to do.
WORDS = 260_000
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_P = np.uint64(PRECISION)
_MASK = np.uint64((1 << PRECISION) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and frequencies that sum to 2**PRECISION, each at least 1."""
    if int(ids.max()) < 1 << 22:  # counted, not sorted, as ids of a vocabulary are small
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts = every[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << PRECISION
    if len(symbols) > total // 2:
        raise ValueError("too many symbols for the precision")
    freqs = np.maximum(1, counts * (total - len(symbols)) // max(1, counts.sum()))
    over = int(freqs.sum()) - total
    order = np.argsort(-freqs, kind="stable")
    for i in order:  # the rounding goes to the most frequent symbols
        change = min(over, int(freqs[i]) - 1)
        freqs[i] -= change
        over -= change
        if over <= 0:
            break
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode_segment(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    symbols, freqs = frequencies(ids) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    starts = np.concatenate([[0], np.cumsum(freqs[:-1], dtype=np.uint64)]).astype(np.uint64) if n else np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    steps = min(BLOCK, -(-n // LANES) * LANES) // LANES if n else 0
    streams, marks, states_out = [b""] * blocks, [], []
    if n:
        rank = np.zeros(int(symbols[-1]) + 1, np.int32)
        rank[symbols] = np.arange(len(symbols), dtype=np.int32)
        padded = np.full(blocks * steps * LANES, int(np.argmax(freqs)), np.int32)
        padded[:n] = rank[ids]
        at = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES))
        f64, most = freqs.astype(np.uint64), freqs.astype(np.uint64) << np.uint64(63 - PRECISION)
        x = np.full(blocks * LANES, LOW)
        words = np.zeros((steps, blocks * LANES), "<u4")
        put = np.zeros((steps, blocks * LANES), bool)
        for t in range(steps - 1, -1, -1):
            s = at[t]
            f = f64[s]
            full = x >= most[s]
            put[t] = full
            words[t] = x & np.uint64(0xFFFFFFFF)
            x = np.where(full, x >> _32, x)
            q = x // f
            x = (q << _P) + (x - q * f) + starts[s]
            if t % STRIDE == 0:
                states_out.append(x.astype("<u8"))
        put3 = put.reshape(steps, blocks, LANES)
        words3 = words.reshape(steps, blocks, LANES)
        per_step = put3.sum(axis=2)
        before = np.cumsum(per_step, axis=0) - per_step
        marks = before[::STRIDE].astype("<u4")  # (checkpoints, blocks)
        streams = [words3[:, b][put3[:, b]].tobytes() for b in range(blocks)]
    crcs = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)], "<u4")
    known = np.array([d is not None for d in doc_ids], bool)
    sections = [
        symbols.astype("<u4").tobytes(), freqs.astype("<u4").tobytes(),
        zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes(), 1), np.packbits(known).tobytes(),
        zlib.compress(np.array(sizes, "<u4").tobytes(), 1), crcs.tobytes(),
        b"".join(s.tobytes() for s in states_out[::-1]), np.asarray(marks, "<u4").tobytes(), *streams,
    ]
    body = b"".join(sections)
    header = json.dumps({"tokens": n, "docs": len(doc_ids), "blocks": blocks, "steps": steps, "block": BLOCK, "lanes": LANES, "stride": STRIDE, "precision": PRECISION, "sizes": [len(s) for s in sections], "crc": zlib.crc32(body)}).encode()
    return b"LFR1" + struct.pack("<I", len(header)) + header + body


class Segment:
    """Reads one segment: all of it, or some of its blocks from a checkpoint on."""

    def __init__(self, data: bytes):
        if data[:4] != b"LFR1":
            raise ValueError("not a segment")
        size = struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(data[8 : 8 + size])
        body = memoryview(data)[8 + size :]
        if zlib.crc32(body) != self.head["crc"]:
            raise ValueError("the segment's checksum differs")
        ends = np.cumsum(self.head["sizes"])
        part = [body[e - s : e] for e, s in zip(ends, self.head["sizes"], strict=True)]
        self.symbols, self.freqs = np.frombuffer(part[0], "<u4"), np.frombuffer(part[1], "<u4")
        known = np.unpackbits(np.frombuffer(part[3], np.uint8))[: self.head["docs"]]
        self.docs = [d if k else None for d, k in zip(np.frombuffer(zlib.decompress(part[2]), "<i8").tolist(), known, strict=True)]
        self.sizes, self.crcs = np.frombuffer(zlib.decompress(part[4]), "<u4"), np.frombuffer(part[5], "<u4")
        blocks = self.head["blocks"]
        self.states = np.frombuffer(part[6], "<u8").reshape(-1, blocks, self.head["lanes"]) if blocks else None
        self.marks = np.frombuffer(part[7], "<u4").reshape(-1, blocks) if blocks else None
        self.streams = [np.frombuffer(p, "<u4") for p in part[8:]]

    def decode(self, blocks: range | None = None, checkpoint: int = 0) -> np.ndarray:
        """Ids of the given blocks (all), each from its checkpoint on; whole blocks are held against their checksums."""
        head = self.head
        blocks = range(head["blocks"]) if blocks is None else blocks
        if not len(blocks):
            return np.zeros(0, np.uint32)
        first, steps, lanes, shift = checkpoint * head["stride"], head["steps"], head["lanes"], np.uint64(head["precision"])
        mask = np.uint64((1 << head["precision"]) - 1)
        slot = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freqs)
        start = (np.cumsum(self.freqs, dtype=np.uint64) - self.freqs).astype(np.uint64)
        f64 = self.freqs.astype(np.uint64)
        own = [self.streams[b] for b in blocks]
        base = np.cumsum([0, *map(len, own)])[:-1]
        words = np.concatenate([*own, np.zeros(1, np.uint32)]).astype(np.uint64)
        at = base + self.marks[checkpoint, blocks.start : blocks.stop : blocks.step]
        x = self.states[checkpoint, blocks.start : blocks.stop : blocks.step].copy()
        out = np.empty((steps - first, len(own), lanes), np.int32)
        for t in range(steps - first):
            low = x & mask
            s = slot[low]
            out[t] = s
            x = f64[s] * (x >> shift) + low - start[s]
            need = x < LOW
            order = np.cumsum(need, axis=1)
            take = words[np.where(need, at[:, None] + order - 1, len(words) - 1)]
            x = np.where(need, (x << _32) | take, x)
            at = at + order[:, -1]
        ids = self.symbols[out.transpose(1, 0, 2).reshape(len(own), -1)]
        parts = []
        for row, b in zip(ids, blocks, strict=True):
            row = row[: max(0, min(head["block"], head["tokens"] - b * head["block"]) - first * lanes)]
            if not checkpoint and zlib.crc32(np.ascontiguousarray(row, "<u4")) != self.crcs[b]:
                raise ValueError(f"the checksum of block {b} differs")
            parts.append(row)
        return np.concatenate(parts)


_FILES = "part long, segment long, n_docs long, n_tokens long, content binary"


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """Segments in ascending doc_id order: (part, segment) orders them."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, part, number = encoder(path, WORDS).encode, TaskContext.get().partitionId(), 0
        ids, sizes, parts, total = [], [], [], 0

        def close():
            data = encode_segment(ids, sizes, np.frombuffer(b"".join(parts), "<u4"))
            values = ([part], [number], [len(ids)], [total], [data])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "segment", "n_docs", "n_tokens", "content"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.append(encode(text) + end)
                ids.append(doc)
                sizes.append(len(parts[-1]) // 4)
                total += sizes[-1]
                if total >= segment:
                    yield close()
                    ids, sizes, parts, total, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    # Rows of one id, or without one, are ordered, and dealt, by a hash of their text.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    return rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, _FILES)


def write_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the segments of a corpus as a Parquet table of (part, segment, n_docs, n_tokens, content)."""
    token_files(docs, path).write.parquet(folder)


def read_documents(files: DataFrame) -> DataFrame:
    """part, segment, doc_id, at (tokens before it in the segment), n_tokens and ids_crc32 of every document."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = Segment(batch.column(2)[k].as_py())
                ids = np.ascontiguousarray(s.decode(), "<u4")
                ends = np.cumsum(s.sizes, dtype=np.int64)
                starts = ends - s.sizes
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                columns = ([batch.column(0)[k].as_py()] * n, [batch.column(1)[k].as_py()] * n, s.docs, starts, s.sizes, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.select("part", "segment", "content").mapInArrow(run, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")


def segment_starts(files: DataFrame) -> DataFrame:
    """Tokens before each segment, summed part by part so that no task sees all segments."""
    own = files.select("part", "segment", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("_part") + F.col("_within")).alias("base"))


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the whole corpus as segments, read the files back, and say where each document's ids are."""
    files = written(token_files(docs, path), "tokens")
    return read_documents(files).join(segment_starts(files), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
