"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's bytes are lower-cased, everything in ASCII that is no letter becomes a space, and its windows of 2, 3 and 4 bytes are hashed
into `BUCKETS`. The mean of the buckets' embeddings goes through one linear layer. Both are trained by stochastic gradient descent
in numpy, on at most `PER_LANG` different labelled rows of each language (those of smallest hash; the bound is this parameter, and holds
also where ids or rows repeat).
One row in five of these is set aside: a temperature is fitted to it, and the score below which a prediction is rejected is the
`REJECT` quantile of the calibrated scores of its correctly predicted rows, at most `MOST_CUT`.

The mean is linear, so prediction needs only the product of embeddings and layer: one row of logits for each bucket.

Only text is an input of a prediction. Null texts and texts without a letter are `und` with score 0 and count as rejected. Without any
labelled rows every text is `und`. Texts of any length are taken whole. Languages that tie go to the first in alphabetical order. Repeated
rows are predicted alike; a null doc_id counts as not held out and not for learning; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches

BUCKETS = 1 << 14
WIDTH = 8
PER_LANG = 1000
EPOCHS = 12
#: Fewest batches that training takes; small tables get more epochs.
STEPS = 400
RATE = 40.0
REJECT = 0.002
MOST_CUT = 0.6
#: Bytes looked at together; a longer text is taken in such parts.
PART = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def subwords(data: bytes) -> np.ndarray:
    """Buckets of all windows of 2, 3 and 4 bytes."""
    b = np.frombuffer(b" " + data.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    out, h = [], b
    for n in (2, 3, 4):
        h = h[:-1] << np.uint32(8) | b[n - 1 :]
        if not len(h):
            break
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
        out.append((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(18))
    return np.concatenate(out).astype(np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and the share of each."""
    counts = np.zeros(BUCKETS, np.int64)
    data = text.encode("utf-8", "surrogatepass")
    for i in range(0, len(data), PART):
        counts += np.bincount(subwords(data[i : i + PART]), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float = 1.0
    cut: float = 0.0

    def raw(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        data = text.encode("utf-8", "surrogatepass")
        for i in range(0, len(data), PART):
            s = subwords(data[i : i + PART])
            total += self.logits[s].sum(axis=0, dtype=np.float64)
            n += len(s)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        z = self.raw(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.langs[k], float(p[k]), bool(p[k] < self.cut)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 1, epochs: int = EPOCHS, rate: float = RATE, batch: int = 32) -> Model:
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, own = order[: len(y) // 5], order[len(y) // 5 :]
    table = (rng.standard_normal((BUCKETS, WIDTH)) * 0.3).astype(np.float32)
    layer, bias = (rng.standard_normal((WIDTH, len(langs))) * 0.3).astype(np.float32), np.zeros(len(langs), np.float32)
    epochs = max(epochs, -(-STEPS * batch // max(1, len(own))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(own), batch):
            rows = own[i : i + batch]
            at = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            mean = np.add.reduceat(table[at] * share[:, None], starts, axis=0)
            wrong = _softmax(mean @ layer + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = (wrong @ layer.T)[row] * share[:, None]
            layer -= step * 0.05 * (mean.T @ wrong)
            bias -= step * 0.01 * wrong.sum(axis=0)
            for k in range(WIDTH):
                table[:, k] -= step * np.bincount(at, weights=back[:, k], minlength=BUCKETS).astype(np.float32)
        own = rng.permutation(own)
    model = Model(langs, (table @ layer).astype(np.float32), bias.astype(np.float64))
    if len(aside):
        z = np.array([bags[r][1] @ model.logits[bags[r][0]] + bias for r in aside], np.float64)
        t = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
        loss = [-np.log(np.maximum(_softmax(z / v)[np.arange(len(aside)), y[aside]], 1e-12)).mean() for v in t]
        model.temperature = float(t[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[aside]
        if right.any():
            model.cut = float(min(MOST_CUT, np.quantile(p.max(axis=1)[right], REJECT)))
    return model


def sample(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> DataFrame:
    """lang, h and text of at most `per_lang` different labelled rows of each language: those of the smallest hash of id and text.

    The number of different hashes of each language is estimated first, so that only about twice `per_lang` rows of a language pass the
    threshold set by it and are sent to the exact cut, however many rows or copies the language has.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    labelled = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), h.alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(2.0 * per_lang / max(1, n)))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    few = labelled.where(F.col("h") / F.lit(2.0**63) < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return few.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_k") <= per_lang).drop("_k")


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    """Train on rows where `learn` holds and text and lang are not null.

    One task trains on the sample, which is bounded; only the model, 64 KB a language, comes to the driver.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            bags = [bag(t) if t else (np.zeros(0, np.int32), np.zeros(0, np.float32)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x, _ in bags], pa.binary()), pa.array([w.tobytes() for _, w in bags], pa.binary())], names=["lang", "h", "at", "share"])

    def learnt(batches):
        found = [r for b in batches for r in b.to_pylist() if r["at"]]
        found.sort(key=lambda r: (r["lang"], r["h"]))
        m = train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32)) for r in found], [r["lang"] for r in found])
        columns = ([m.langs], [m.logits.tobytes()], [m.bias.astype(np.float64).tobytes()], [m.temperature], [m.cut])
        kinds = (pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["langs", "logits", "bias", "temperature", "cut"])

    bags = sample(docs, learn, per_lang).select("text", "lang", "h").mapInArrow(run, "lang string, h long, at binary, share binary")
    row = bags.repartition(1).mapInArrow(learnt, "langs array<string>, logits binary, bias binary, temperature double, cut double").first()
    if row is None or not row["langs"]:
        return train([], [])
    return Model(list(row["langs"]), np.frombuffer(bytes(row["logits"]), np.float32).reshape(BUCKETS, -1), np.frombuffer(bytes(row["bias"])), row["temperature"], row["cut"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred, score and lang_rejected (columns of these names are replaced)."""
    bounded_batches(docs.sparkSession)
    new = ("lang_pred", "score", "lang_rejected")
    kept = [f for f in docs.schema if f.name not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]) + ", lang_pred string, score double, lang_rejected boolean"
    names = [f.name for f in kept]
    position = names.index("text")

    def run(batches):
        for b in batches:
            found = [model.predict(t) for t in b.column(position).to_pylist()]
            lang, score, out = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*names, *new])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows kept from training: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and lang_rejected, learnt from the rows that are not held out."""
    model = fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return predict(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is not rejected, all their columns."""
    model = fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    carried = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return predict(carried, model).where("NOT lang_rejected").select("_row.*")
