"""Toxicity by maximum-scoring segments.

Each token has the log-odds of toxic against other text, of either sign, with a Dirichlet prior in proportion to the
token's share of both, drawn towards 0 by some standard deviations of its own, less a drift that makes the expected
score of ordinary text negative. One linear scan of a text finds all its maximal-scoring segments. A segment of score S
is significant by extreme-value statistics: over n tokens of ordinary text, K n exp(-lambda S) segments of that score
are expected, lambda being the solution of E[exp(lambda s)] = 1 over ordinary tokens and K what the best segments of
ordinary rows have. A document's evidence is the sum of lambda S - log(K n) over its significant segments; a logistic
curve fitted to the learnt rows makes it a probability.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import agreed_labels, byte_texts, hashes, held_out, map_arrow, mix, pick, read

#: Bits of the hashed vocabulary: one float a place, 4 MB.
BITS = 20
#: Rows learnt from, at most; the prior's weight as a share of all that is counted; standard deviations that a token's
#: log-odds lose; drift a token. The last three were chosen by three-fold cross-validation within rows that may be learnt from.
MAX_TRAIN, PRIOR, DEVIATIONS, DRIFT = 12_000, 0.5, 1.5, 0.2

WORD = re.compile(rb"[a-z0-9_\x80-\xff]+")


def places(text: bytes) -> np.ndarray:
    """The hashed place of each token; tokens are runs of letters and digits, A-Z lower-cased."""
    words = WORD.findall(text.lower())
    return (mix(hashes(words)) >> np.uint64(64 - BITS)).astype(np.int64) if words else np.zeros(0, np.int64)


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, prior: float = PRIOR, deviations: float = DEVIATIONS) -> np.ndarray:
    """Each place's score from the numbers of documents of either kind that hold it: log-odds under the Dirichlet prior, of either sign, so many of its standard deviations nearer to 0; 0 for places never seen."""
    both = toxic + other
    if not n_toxic or not n_other:
        return np.zeros(len(both), np.float32)
    a, b = (x + prior * both for x in (toxic, other))
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
        sure = np.sign(delta) * np.maximum(np.abs(delta) - deviations * np.sqrt(1 / a + 1 / b), 0)
    return np.where(both > 0, sure, 0).astype(np.float32)


def segments(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of the scores less the drift, in order.

    A run of tokens above the drift is one candidate. A candidate joins the nearest earlier one whose left sum is lower
    if its own right sum is the higher, and then looks on from there. Each candidate keeps a link to that nearest one,
    and the search goes along the links; none is followed twice, so the work is linear in the tokens.
    """
    s = scores.astype(np.float64) - drift
    edge = np.flatnonzero(np.diff(np.concatenate([[False], s > 0, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(s)])
    begin, end = edge[::2], edge[1::2]
    left, right, first, last, link = [], [], [], [], []
    for low, high, a, e in zip(total[begin].tolist(), total[end].tolist(), begin.tolist(), end.tolist()):
        j = len(left) - 1
        while j >= 0 and left[j] >= low:
            j = link[j]
        while j >= 0 and right[j] < high:
            low, a, before = left[j], first[j], link[j]
            for x in (left, right, first, last, link):
                del x[j:]
            j = before
        for x, v in ((left, low), (right, high), (first, a), (last, e), (link, j)):
            x.append(v)
    return [(r - lo, a, e) for lo, r, a, e in zip(left, right, first, last)]


def scale(scores: np.ndarray, share: np.ndarray, drift: float = DRIFT) -> float:
    """lambda: the positive solution of E[exp(lambda s)] = 1 for tokens of the given shares."""
    s = scores.astype(np.float64) - drift
    if not len(s) or s.max() <= 0 or (share * s).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: (share * np.exp(np.minimum(x * s, 500))).sum() - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def bar(n: int, k: float) -> float:
    """log(K n): lambda S of a segment that is expected once in ``n`` ordinary tokens; not below 0."""
    return max(0.0, float(np.log(max(k * max(n, 1), 1e-9))))


def evidence(text_scores: np.ndarray, lam: float, k: float, drift: float = DRIFT) -> float:
    """The sum of lambda S - log(K n) over the segments that are expected less than once."""
    least = bar(len(text_scores), k)
    return float(sum(max(0.0, lam * s - least) for s, _, _ in segments(text_scores, drift)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton's method with a little shrinkage, a step halved until it helps; the slope is not below 0."""
    m, shrink = np.column_stack([x, np.ones(len(x))]), np.array([1e-2, 1e-4])

    def loss(a: np.ndarray) -> float:
        z = m @ a
        return float(np.logaddexp(0, z).sum() - y @ z + (shrink * a * a).sum() / 2)

    a = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -500, 500)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(shrink), m.T @ (y - p) - shrink * a)
        size = 1.0
        while size > 1e-6 and loss(a + size * step) > loss(a):
            size /= 2
        a = a + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(a[0]), 0.0), float(a[1])


def unlike(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """One row of those with the same tokens and label: copies would count their words as often as there are copies."""
    return list({(p.tobytes(), y): (p, y) for p, y in rows}.values())


def best_score(scores: np.ndarray, drift: float) -> float:
    return max((s for s, _, _ in segments(scores, drift)), default=0.0)


#: The mean of the standard Gumbel distribution, Euler's constant.
GUMBEL_MEAN = 0.5772156649015329


def statistics(rows: list[tuple[np.ndarray, int]], prior: float, deviations: float, drift: float) -> tuple[np.ndarray, float, float]:
    """(scores, lambda, K) of rows of tokens and label."""
    size = 1 << BITS
    toxic, other, counts = np.zeros(size), np.zeros(size), np.zeros(size)
    for p, y in rows:
        np.add.at(toxic if y else other, np.unique(p), 1.0)
        if not y:
            np.add.at(counts, p, 1.0)
    n_toxic = sum(y for _, y in rows)
    scores = log_odds(toxic, other, n_toxic, len(rows) - n_toxic, prior, deviations)
    lam = scale(scores, counts / max(counts.sum(), 1), drift)
    # the best segment of n ordinary tokens is Gumbel distributed about log(K n) / lambda: K by the mean of what rows have
    best = [lam * best_score(scores[p], drift) - np.log(len(p)) for p, y in rows if not y and len(p)]
    return scores, lam, float(np.exp(np.mean(best) - GUMBEL_MEAN)) if best else 1.0


def fit(rows: list[tuple[np.ndarray, int]], prior: float = PRIOR, deviations: float = DEVIATIONS, drift: float = DRIFT) -> dict:
    rows = unlike(rows)
    scores, lam, k = statistics(rows, prior, deviations, drift)
    x = np.array([np.log1p(evidence(scores[p], lam, k, drift)) for p, _ in rows])
    slope, at = logistic(x, np.array([y for _, y in rows], float)) if rows else (0.0, -2.0)
    return {"scores": scores, "lam": lam, "k": k, "slope": slope, "at": at}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_TRAIN) -> dict:
    """The model from a bounded sample of labelled rows (see agreed_labels), gathered as token places in one task."""
    few = agreed_labels(labels, label, bound)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("doc_id").cast("long"), "text", "y")

    def tokens(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([places(t).astype("<i4").tobytes() for t in byte_texts(b)], pa.binary())], ["doc_id", "y", "p"])

    # of rows that share an id the one with the smallest tokens, the same in each run
    rows = map_arrow(rows, tokens, "doc_id long, y int, p binary").groupBy("doc_id").agg(F.min(F.struct("p", "y")).alias("r")).select("doc_id", "r.y", "r.p")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        m = fit([(np.frombuffer(p, "<i4").astype(np.int64), int(y)) for p, y in zip(pdf["p"], pdf["y"])])
        return pd.DataFrame({"scores": [m["scores"].astype("<f4").tobytes()]} | {k: [m[k]] for k in ("lam", "k", "slope", "at")})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "scores binary, lam double, k double, slope double, at double").collect()
    if not got:
        return {"scores": np.zeros(1 << BITS, np.float32), "lam": 1.0, "k": 1.0, "slope": 0.0, "at": -2.0}
    return got[0].asDict() | {"scores": np.frombuffer(got[0]["scores"], "<f4")}


def passages(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score, predicted, and n_passages and passages, the significant segments as structs of first word, end word and score.

    Whole texts are scanned; a null or empty text has no segments and the score of no evidence. Other columns aren't
    read; repeated rows score alike; a null id is not held out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out, spans = [], []
            for t in byte_texts(b):
                s = m["scores"][places(t)]
                least = bar(len(s), m["k"])
                good = [(x, a, e) for x, a, e in segments(s) if m["lam"] * x > least]
                total = sum(m["lam"] * x - least for x, _, _ in good)
                z = m["slope"] * np.log1p(total) + m["at"]
                out.append(float(1 / (1 + np.exp(-z))))
                spans.append([{"start": a, "end": e, "score": float(x)} for x, a, e in good])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "score", "passages"])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    found = map_arrow(base, run, "doc_id long, held_out boolean, score double, passages array<struct<start:int,end:int,score:double>>")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return passages(docs, learn(docs, read(spark, sf_dir, "labels"))).drop("passages")
