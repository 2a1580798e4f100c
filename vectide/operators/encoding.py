"""Encoding token ids through a backbone: dense vectors, token weights and one vector a token."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import BEGIN, END, PAD, UNKNOWN
from ..functions.vectors import NORM_EPS
from .batching import BATCH_SIZE, BATCH_TOKENS

#: (ids, mask) -> hidden states: int64 [texts, width] twice to float [texts, width, channels].
Backbone = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Heads:
    """Weights of the sparse head (channels) with its bias, and of the colbert head (channels in, channels out) with its own."""

    sparse: np.ndarray
    sparse_bias: float
    colbert: np.ndarray
    colbert_bias: np.ndarray


def test_backbone(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A closed form that tests plumbing and has no meaning: 1, id modulo 7, position modulo 5."""
    place = np.broadcast_to(np.arange(ids.shape[1]) % 5, ids.shape)
    return np.stack([np.ones(ids.shape), ids % 7, place], axis=-1).astype(np.float32) * mask[..., None]


TEST_HEADS = Heads(np.array([0.5, 0.25, -0.125], np.float32), -0.5, np.array([[1, 0, 1], [1, 1, 0], [0, -1, 1]], np.float32), np.zeros(3, np.float32))


def onnx_backbone(path: str) -> Backbone:
    """The ONNX model at ``path``, one thread a task; loaded when first called, in the worker."""
    held: list = []

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if not held:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            options.add_session_config_entry("session.intra_op.allow_spinning", "0")
            held.append(onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"]))
        session = held[0]
        names = [i.name for i in session.get_inputs()]
        return session.run(None, dict(zip(names, (ids, mask))))[0]

    return run


def batches_of(lengths: list[int], batch_size: int, budget: int) -> list[list[int]]:
    """Groups of positions, longest first with ties in order: at most ``batch_size`` in one and, but for a single long one, within the budget of padded tokens."""
    if batch_size < 1 or budget < 1:
        raise ValueError("batch_size and budget must be positive")
    out: list[list[int]] = []
    width = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if out and len(out[-1]) < batch_size and (len(out[-1]) + 1) * width <= budget:
            out[-1].append(i)
        else:
            width = lengths[i]
            out.append([i])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), NORM_EPS)


def token_weights(ids: list[int], weights: np.ndarray) -> list[tuple[str, float]]:
    """The largest positive weight of each token but begin, pad, end and unknown, by the token's decimal string, in order of first appearance."""
    best: dict[int, float] = {}
    for t, w in zip(ids, weights.tolist()):
        if w > 0 and t not in (BEGIN, PAD, END, UNKNOWN) and w > best.get(t, 0.0):
            best[t] = w
    return [(str(t), w) for t, w in best.items()]


def encode(tokens: DataFrame, backbone: Backbone, heads: Heads, key: str = "doc_id", dense: bool = False, sparse: bool = False, colbert: bool = False, batch_size: int = BATCH_SIZE, budget: int = BATCH_TOKENS, wide: bool = False) -> DataFrame:
    """(key, dense_vecs, lexical_weights, colbert_vecs) of (key, ids), the columns asked for only.

    Texts are packed and padded within each Arrow batch and go through the backbone once for all heads; a result
    doesn't depend on what a text is packed with. A head not asked for is not computed. ``wide``: in double.
    """
    real, name, number = (pa.float64(), "double", np.float64) if wide else (pa.float32(), "float", np.float32)
    fields = [(dense, "dense_vecs", pa.list_(real), f"array<{name}>"), (sparse, "lexical_weights", pa.map_(pa.string(), real), f"map<string,{name}>"), (colbert, "colbert_vecs", pa.list_(pa.list_(real)), f"array<array<{name}>>")]
    asked = [(n, t) for on, n, t, _ in fields if on]
    kind = dict(tokens.dtypes)[key]

    def run(batches):
        for b in batches:
            ids = b.column(1).to_pylist()
            out: dict[str, list] = {n: [None] * len(ids) for n, _ in asked}
            for group in batches_of([len(x) for x in ids], batch_size, budget):
                width = len(ids[group[0]])
                matrix = np.full((len(group), width), PAD, np.int64)
                for k, i in enumerate(group):
                    matrix[k, : len(ids[i])] = ids[i]
                mask = (np.arange(width) < np.array([len(ids[i]) for i in group])[:, None]).astype(np.int64)
                hidden = backbone(matrix, mask).astype(number)
                for k, i in enumerate(group):
                    n = len(ids[i])
                    if dense:
                        out["dense_vecs"][i] = unit(hidden[k, 0])
                    if sparse:
                        out["lexical_weights"][i] = token_weights(ids[i], np.maximum(hidden[k, :n] @ heads.sparse + number(heads.sparse_bias), 0))
                    if colbert:
                        out["colbert_vecs"][i] = list(unit(hidden[k, 1:n] @ heads.colbert + heads.colbert_bias))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[n], t) for n, t in asked]], [key, *out])

    return tokens.select(key, "ids").mapInArrow(run, ", ".join([f"{key} {kind}", *[f"{n} {s}" for on, n, _, s in fields if on]]))
