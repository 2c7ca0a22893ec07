"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (one to three lower-case letters, words
bounded by one mark), hashed to ``BUCKETS`` places and scaled to unit length.  Document
frequencies are counted over every training text.  The weights are trained by
follow-the-regularised-leader (proximal, one learning rate per weight) with elastic-net
penalties, which leave most of them zero, on at most ``FIT_ROWS`` texts chosen by a
hash of id and text, and ``LANGUAGE_ROWS`` of each language besides.  A part of those is set aside to fit
the temperature that calibrates the probabilities.

Learning sees only rows with a language and with ``crc32(doc_id)`` modulo 4 other than 2; a
prediction sees the text alone.

Defined results.  A null text, or one without a letter, is ``und`` with score 0, and so is
every text when there is nothing to learn from.  Ties go to the first language in code-point order.
Repeated rows are learned from once and predicted alike, and long texts are read whole.  An empty table gives an empty result.  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, sent, stored, table

BUCKETS = 1 << 14
#: Training texts at most, and passes over them.
FIT_ROWS, EPOCHS = 3000, 4
#: Training texts of each language besides, so that none is unknown because it is rare.
LANGUAGE_ROWS = 30
#: Follow-the-regularised-leader: learning rate, its offset, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: One in so many training texts is set aside for the temperature.
ASIDE = 5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MARK = 0x2E
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether some character is a letter; number forms, marks and digits are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def codes(text: str) -> np.ndarray:
    """Code points of the lower-case letters, every other run as one mark."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (x - np.uint32(97) < 26) | (x >= 0xC0) & (x != 0xD7) & (x != 0xF7) & ~((x >= 0x2000) & (x < 0x2070))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, x, np.uint32(_MARK))[keep]


def buckets(text: str) -> np.ndarray:
    """Counts of hashed n-grams."""
    x = codes(text)
    grams = []
    h = np.zeros(len(x), dtype=np.uint32)
    for n in range(3):
        if len(x) <= n:
            break
        h = (h[: len(x) - n] + x[n:]) * _SALTS[n]
        h ^= h >> np.uint32(15)
        grams.append((h * np.uint32(0x2545F491)) >> np.uint32(32 - 14))
    return np.bincount(np.concatenate(grams), minlength=BUCKETS) if grams else np.zeros(BUCKETS, dtype=np.int64)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    size = np.sqrt(x @ x)
    return at, x / size if size else x


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = vector(buckets(text), self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; every row updates the places that it holds."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bz, bn = np.zeros(k), np.zeros(k)

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    target = np.eye(k)[labels]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w, b = leader(z[at], n[at], L1), leader(bz, bn, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            g = p / p.sum() - target[i]
            full = x[:, None] * g
            z[at] += full - (np.sqrt(n[at] + full**2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += full**2
            bz += g - (np.sqrt(bn + g**2) - np.sqrt(bn)) / ALPHA * b
            bn += g**2
    return leader(z, n, L1), leader(bz, bn, 0.0)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = scores / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean() + 1e-4 * t * t)

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, total = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found += buckets(text.as_py()) > 0
            total += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *at], pa.int32()), "texts": pa.array([total, *found[at]], pa.int64())})


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column("text"):
            counts = buckets(text.as_py())
            places = np.flatnonzero(counts)
            at.append(places.astype(np.int32))
            n.append(counts[places].astype(np.int32))
        yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "lang": batch.column("lang"), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.int32()))})


def sample(train: DataFrame, most: int = FIT_ROWS, least: int = LANGUAGE_ROWS) -> DataFrame:
    """``h, lang, text``: the ``most`` texts whose hash of id and text is least, and the ``least`` first of every language.  Rows that are alike count once."""
    h = F.xxhash64(F.lit("language"), "doc_id", "text").alias("h")
    first = train.select(h, "lang").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most)
    first = stored(first, "sample")
    keys = stored(first.orderBy("h", "lang").limit(most).unionByName(first.where(F.col("k") <= least)).select("h", "lang").distinct(), "sample")
    return train.select(h, "lang", "text").join(sent(keys), ["h", "lang"]).groupBy("h", "lang").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, most: int = FIT_ROWS) -> Model:
    train = docs.where("text is not null and lang is not null").where(crc_mod(F.col("doc_id"), 4) != 2)
    counted = train.select("text").mapInArrow(count_documents, "bucket int, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()
    texts = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))
    total = texts.pop(-1, 0)
    if not total:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 1.0)
    idf = np.full(BUCKETS, np.log1p(total))
    for b, n in texts.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 1e-3
    chosen = sample(train, most).mapInArrow(featurise, "h long, lang string, at array<int>, n array<int>")
    rows = sorted(zip(*(c.to_pylist() for c in chosen.toArrow().columns), strict=True), key=lambda r: (r[0], r[1]))
    langs = sorted({r[1] for r in rows})
    vectors, labels = [], np.array([langs.index(r[1]) for r in rows])
    for _, _, at, n in rows:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        counts[at] = n
        vectors.append(vector(counts, idf))
    aside = np.arange(len(rows)) % ASIDE == ASIDE - 1
    kept = [v for v, a in zip(vectors, aside, strict=True) if not a]
    weights, bias = ftrl(kept, labels[~aside], len(langs))
    held = np.array([x @ weights[at] + bias for (at, x), a in zip(vectors, aside, strict=True) if a]).reshape(-1, len(langs))
    return Model(langs, idf, weights, bias, temperature(held, labels[aside]))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``."""
    given = docs.sparkSession.sparkContext.broadcast(model._asdict())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**given.value)
        for batch in batches:
            found = [m.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()),
            })

    return docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs))
