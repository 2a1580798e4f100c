"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates
(FTRL-proximal) and scored as sparse dot products."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import agreed_labels, byte_texts, hashes, held_out, map_arrow, mix, numbered, pick, read

#: Bits of the hashed feature space: the model is one double a place, 2 MB.
BITS = 18
#: Rows learnt from, at most; epochs; FTRL's rates and penalties.
MAX_TRAIN, EPOCHS, ALPHA, BETA, L1, L2 = 6_000, 3, 0.5, 1.0, 0.02, 0.5

TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\x20\x09-\x0DA-Za-z0-9_\x80-\xff]+")


def _shape(word: bytes) -> bytes:
    """What kind of token: punctuation itself (4 bytes of it), or the case of a word."""
    c = word[0]
    if not (c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 95):
        return word[:4]
    return b"<N>" if word.isdigit() else b"<U>" if word.isupper() and len(word) > 1 else b"<T>" if word[:1].isupper() else b"<l>"


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): word uni- and bigrams, tri- and bigrams of word shapes, and repeats of a word; log counts, scaled to length 1. An empty text has none."""
    words = TOKEN.findall(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore"):
        h = hashes(words)
        kinds: dict[bytes, bytes] = {}
        s = hashes([kinds.get(w) or kinds.setdefault(w, _shape(w)) for w in words])
        two = h[:-1] * np.uint64(3) + h[1:]
        two[h[:-1] == h[1:]] = np.uint64(7)
        shape2 = s[:-1] * np.uint64(5) + s[1:] + np.uint64(11)
        shape3 = (s[:-2] * np.uint64(5) + s[1:-1]) * np.uint64(5) + s[2:] + np.uint64(13) if len(s) > 2 else s[:0]
        places = (mix(np.concatenate([h, two, shape2, shape3, s + np.uint64(17)])) >> np.uint64(64 - BITS)).astype(np.int64)
    places, counts = np.unique(places, return_counts=True)
    values = np.log1p(counts)
    return places, values / np.sqrt((values * values).sum())


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, the bias last. Without examples, or with one label only, the weights of no features are 0."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, values, y in examples:
            at, x = np.append(places, size - 1), np.append(values, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_TRAIN) -> np.ndarray:
    """The model from a bounded sample of labelled rows (see agreed_labels); whole texts. Its features, a few kB a row, are gathered in one task."""
    few = agreed_labels(labels, label, bound)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("doc_id").cast("long"), "text", "y")

    def featurise(batches):
        for b in batches:
            found = [features(t) for t in byte_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "y", "p", "v"])

    # of rows that share an id the one with the smallest features, the same in each run
    rows = map_arrow(rows, featurise, "doc_id long, y int, p binary, v binary").groupBy("doc_id").agg(F.min(F.struct("p", "v", "y")).alias("r")).select("doc_id", "r.*")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(mix(pdf["doc_id"].to_numpy(np.int64).astype(np.uint64)), kind="stable")]
        w = fit([(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), y) for p, v, y in zip(pdf["p"], pdf["v"], pdf["y"])])
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f8") if got else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``: whole texts; null and empty ones have the bias alone. Other columns aren't read; repeated rows score alike; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, t in enumerate(byte_texts(b)):
                p, v = features(t)
                out[i] = w[p] @ v + w[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-out)))], ["doc_id", "held_out", "score"])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")

    scored = map_arrow(base, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    own, (at,) = numbered(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    least = np.log(threshold / (1 - threshold))

    def run(batches):
        w = shared.value
        for b in batches:
            good = []
            for t in byte_texts(b, f"c{at}"):
                p, v = features(t)
                good.append(bool(w[p] @ v + w[-1] >= least))
            yield b.filter(pa.array(good, pa.bool_()))

    return map_arrow(own, run, own.schema).toDF(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
