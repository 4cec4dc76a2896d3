"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates, sparse dot products.

A text's tokens are runs of letters (A-Z as a-z; everything outside ASCII counts as a letter), runs of digits, and runs of one other sign.
Tokens, pairs of neighbours, and a mark for each word in capitals and one for each word that repeats the word before it, are hashed into
`BUCKETS`; a bucket's value is 1 + log of its count, and a text's values are scaled to length 1. A text so has at most `BUCKETS` values,
whatever its length.

The weights are fitted with one FTRL-proximal update for each labelled text (a state (z, n) for each weight; a weight is 0 until |z| passes
`L1`), in `EPOCHS` passes over a bounded sample: the at most `SAMPLE` labelled rows of smallest hash, of these as many as hold
`MOST_VALUES` values. The sample keeps the labels' shares, so scores read as probabilities. Its tokens are hashed on the executors; the driver gets
bucket numbers, never texts. Scoring is one sparse dot product for each text.

Null labels and null texts are not learnt from; a null text is scored as an empty one. Without any label every score is 0.5, with one kind
of label it tends to that kind. An empty text has no values, so its score is that of the bias. A row of documents with several labels is
learnt from with each; repeated rows are scored alike; a null doc_id has no label and is not held out. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import _BYTE, _POWERS, _mix
from .shared import bounded_batches

BUCKETS = 1 << 17
SAMPLE = 6000
MOST_VALUES = 6_000_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
THRESHOLD = 0.3
#: Bytes looked at together; a longer text is taken in such parts.
PART = 1 << 20

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: What a byte is; those of signs differ from each other, as a sign only goes on with itself.
_KIND = np.array([_LETTER if chr(b).isalpha() and b < 128 or b >= 128 else _DIGIT if 48 <= b <= 57 else _SPACE if b in b" \t\n\x0b\x0c\r" else _SIGN + b for b in range(256)], np.int16)
_UPPER_MARK, _AGAIN_MARK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens, which of them are words, and which are all upper case."""
    raw = np.frombuffer(data, np.uint8)
    kind = np.full(len(raw) + 2, _SPACE, np.int16)
    kind[1:-1] = _KIND[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    start, end = edge[:-1], edge[1:]
    solid = kind[start + 1] != _SPACE
    start, end = start[solid], end[solid]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    up, down = _POWERS.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data.translate(_LOWER), np.uint8)] * up[:-1], out=sums[1:])
    capitals = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=capitals[1:])
    word = kind[start + 1] == _LETTER
    upper = word & (end - start > 1) & (capitals[end] - capitals[start] == end - start)
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), word, upper


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    buckets, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, last, last_word = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    while at < len(data):
        # A part ends before white space, or else goes on, so that no token is cut.
        end = at + PART
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        h, word, upper = tokens(data[at:end])
        at = end
        if not len(h):
            continue
        chain, words = np.concatenate([last, h]), np.concatenate([last_word, h[word]])
        with np.errstate(over="ignore"):
            pairs = _mix(chain[:-1] * _PAIR + chain[1:])
        marks = np.repeat([_UPPER_MARK, _AGAIN_MARK], [int(upper.sum()), int((words[1:] == words[:-1]).sum())])
        found = (np.concatenate([h, pairs, marks]) >> np.uint64(40)).astype(np.int64) % BUCKETS
        own, n = np.unique(found, return_counts=True)
        merged, back = np.unique(np.concatenate([buckets, own]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n])).astype(np.int64)
        buckets, last, last_word = merged, h[-1:], words[-1:]
    values = 1 + np.log(counts)
    return buckets.astype(np.int32), (values / max(1e-12, np.sqrt((values**2).sum()))).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, value = features(text)
        z = float(self.weights[at].astype(np.float64) @ value.astype(np.float64)) + self.bias
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


class Leader:
    """FTRL-proximal state of all weights; the bias is a weight that is not shrunk."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w @ value + b, -60, 60)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        gb = float(p - label)
        self.bias_z += gb - ((self.bias_n + gb * gb) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += gb * gb


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Model:
    leader, rng = Leader(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            leader.update(rows[i][0], rows[i][1].astype(np.float64), labels[i])
    return Model(leader.weights(slice(None)).astype(np.float32), float(leader.bias()))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> DataFrame:
    """text, h and label of at most `most` labelled rows: those of smallest hash of id and text.

    How many there are is counted first, so that only about twice `most` rows are sent to the exact cut.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & learn)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    both = texts.withColumn("h", h)
    n = texts.select("doc_id").join(named, "doc_id").count()
    few = both.where(F.col("h") / F.lit(2.0**63) < min(1.0, 2.0 * most / max(1, n))).join(named, "doc_id")
    # At most about twice `most` rows.
    return few.withColumn("_k", F.row_number().over(Window.orderBy("h", "doc_id", "label"))).where(F.col("_k") <= most).drop("_k", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE, values: int = MOST_VALUES) -> Model:
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([len(a) for a, _ in found], pa.int64()), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in found], pa.binary())],
                names=["h", "label", "n", "at", "value"],
            )

    rows = sample(docs, labels, learn, most).select("text", "h", "label").repartition(max(1, min(64, most // 200))).mapInArrow(run, "h long, label int, n long, at binary, value binary")
    cut = rows.withColumn("_n", F.sum("n").over(Window.orderBy("h", "label"))).where(F.col("_n") <= values)
    found = sorted(cut.select("h", "label", "at", "value").toArrow().to_pylist(), key=lambda r: (r["h"], r["label"]))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float16)) for r in found], [r["label"] for r in found])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with `score` and `predicted` (columns of these names are replaced)."""
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    position = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches):
        for b in batches:
            p = np.array([shared.value.score(t) for t in b.column(position).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]) + ", score double, predicted int"
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows kept from training: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learnt from the labels of rows that are not held out."""
    model = fit(docs, labels, ~held_out())
    return score(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), model).drop("text")
