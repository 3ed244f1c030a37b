"""Document quality: random-indexing word vectors, pooled, into a calibrated two-layer network.

Random indexing: each word has a fixed sparse ternary index vector; a word's context vector is the
sum of the index vectors of the words beside it over the whole corpus. Words are hashed to slots, so
the counts form one integer matrix of fixed size that tasks add up exactly, in any order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import adam, collect_rows, fold, labelled_sample, per_batch, per_group, record, sigmoid

HELD_OUT_MOD, HELD_OUT = 4, 2
#: Word slots, size of a vector, non-zero places of an index vector, slots in a block of the summed matrix.
SLOTS, DIM, PLACES, BLOCK = 1 << 13, 48, 4, 512
#: Numbers beside the mean vector: repeats, distinct words, length.
EXTRA = 3
#: Words pooled at once.
CHUNK = 1 << 17


class Model(NamedTuple):
    """Slot vectors, the network, and the temperature of its output."""

    vectors: np.ndarray
    net: dict
    temperature: float
    bias: float


def _slots(texts: pa.Array):
    """Runs of texts with the slot of each word; case and signs stay, as they tell junk from prose."""
    for i, j, _, w in words.runs(texts, words.SPACED, lower=False):
        yield i, j, (w.hash % words.U64(SLOTS)).astype(np.int64), w.first


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the non-zero entries of each slot's index vector."""
    rng = np.random.default_rng(20)
    place = np.array([rng.choice(DIM, PLACES, replace=False) for _ in range(SLOTS)])
    return place, rng.choice([-1, 1], (SLOTS, PLACES))


def context_vectors(docs: DataFrame, window: int = 2) -> np.ndarray:
    """Context vectors of all slots over every word of every text, ``window`` neighbours to each side."""
    place, sign = _index_vectors()
    schema = "block long, sums binary"

    def count(batches):
        total = np.zeros(SLOTS * DIM)
        for batch in batches:
            for _, _, slot, first in _slots(batch.column(0)):
                edge = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, window + 1):
                    a, b = slot[:-gap], slot[gap:]
                    same = edge[:-gap] == edge[gap:]
                    a, b = a[same], b[same]
                    for k in range(PLACES):
                        total += np.bincount(a * DIM + place[b, k], sign[b, k], SLOTS * DIM)
                        total += np.bincount(b * DIM + place[a, k], sign[a, k], SLOTS * DIM)
        blocks = total.astype(np.int64).reshape(SLOTS // BLOCK, -1)
        yield record({"block": np.arange(len(blocks)), "sums": [x.tobytes() for x in blocks]}, schema)

    def add(rows: pa.Table) -> dict:
        total = np.zeros(BLOCK * DIM, np.int64)
        for sums in rows["sums"]:
            total += np.frombuffer(sums.as_buffer(), np.int64)
        return {"block": rows["block"][:1], "sums": [total.tobytes()]}

    sums = per_group(docs.select("text").mapInArrow(count, schema), ["block"], schema, add)
    rows = collect_rows(sums.orderBy("block"))  # SLOTS x DIM numbers, whatever the corpus
    vectors = np.zeros((SLOTS // BLOCK, BLOCK * DIM))
    for block, got in zip(rows["block"].to_pylist(), rows["sums"].to_pylist()):
        vectors[block] = np.frombuffer(got, np.int64)
    vectors = vectors.reshape(SLOTS, DIM)
    # a slot's own index vector keeps it apart from others with the same company
    own = np.zeros_like(vectors)
    np.put_along_axis(own, place, sign.astype(float), 1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([vectors / np.maximum(norm, 1), own / np.sqrt(PLACES)]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, the share of words that repeat the one before, the share of
    distinct words and the log of the length; zeros for a text without words."""
    out = np.zeros((len(texts), vectors.shape[1] + EXTRA), np.float32)
    for i, j, slot, first in _slots(texts):
        n = np.diff(first)
        # the mean needs each slot once with its count
        key, times = np.unique(np.repeat(np.arange(j - i), n) * SLOTS + slot, return_counts=True)
        for at in range(0, len(key), CHUNK):
            text, weight = key[at : at + CHUNK] // SLOTS, times[at : at + CHUNK, None].astype(np.float32)
            begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out[i + text[begin], :-EXTRA] += np.add.reduceat(vectors[key[at : at + CHUNK] % SLOTS] * weight, begin)
        out[i:j, :-EXTRA] /= np.maximum(n, 1)[:, None]
        owner = np.repeat(np.arange(j - i), n)
        again = (slot[1:] == slot[:-1]) & (owner[1:] == owner[:-1])
        out[i:j, -3] = np.bincount(owner[1:][again], minlength=j - i) / np.maximum(n, 1)
        out[i:j, -2] = np.bincount(key // SLOTS, minlength=j - i) / np.maximum(n, 1)
        out[i:j, -1] = np.log1p(n) / 10
    return out


def _logits(x: np.ndarray, q: dict) -> np.ndarray:
    return np.maximum((x - q["mean"]) / q["scale"] @ q["a"] + q["c"], 0) @ q["b"] + q["d"]


def _train(x: np.ndarray, y: np.ndarray, hidden: int, steps: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    start = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), "c": np.zeros(hidden), "b": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))

    def grads(q: dict, _: int) -> dict:
        rows = rng.integers(0, len(z), min(512, len(z)))
        zb, yb, wb = z[rows], y[rows], weight[rows]
        h = np.maximum(zb @ q["a"] + q["c"], 0)
        d = (sigmoid(h @ q["b"] + q["d"]) - yb) * wb / len(rows)
        dh = d[:, None] * q["b"] * (h > 0)
        return {"a": zb.T @ dh, "c": dh.sum(0), "b": h.T @ d, "d": np.array([d.sum()])}

    return adam(grads, start, steps, 0.005, 1e-4) | {"mean": mean, "scale": scale}


def _temperature(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature and bias of least log loss on rows that the network hasn't seen, by grid."""
    best = min(((np.logaddexp(0, np.where(y == 1, -1, 1) * (logit / t + b)).mean(), t, b) for t in np.geomspace(0.25, 8, 41) for b in np.linspace(-2, 2, 17)), default=(0, 1.0, 0.0))
    return float(best[1]), float(best[2])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 12_000, hidden: int = 24, steps: int = 1500) -> Model:
    """Vectors from the whole corpus; the network from at most ``max_labels`` labelled rows of the learning fold.

    Every fifth of them is kept back for the temperature. Without rows of both kinds, the model gives
    the share of good rows (one half without any).
    """
    vectors = context_vectors(docs)
    lab = labelled_sample(labels, "quality", fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT, max_labels)
    size = vectors.shape[1] + EXTRA
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")  # max_labels rows of two numbers

    def pool(batch: pa.RecordBatch) -> dict:
        x = pooled(batch.column("text"), vectors)
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [r.tobytes() for r in x]}

    got = collect_rows(per_batch(rows, "doc_id long, y int, x binary", pool).dropDuplicates(["doc_id"]).orderBy("doc_id"))
    y = got["y"].to_numpy().astype(float)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), size).astype(float)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        zero = {"a": np.zeros((size, 1)), "c": np.zeros(1), "b": np.zeros(1), "d": np.zeros(1), "mean": np.zeros(size), "scale": np.ones(size)}
        return Model(vectors, zero, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 5 == 4
    net = _train(x[~aside], y[~aside], hidden, steps, 3)
    return Model(vectors, net, *_temperature(_logits(x[aside], net), y[aside]))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    return sigmoid(_logits(pooled(texts, model.vectors), model.net) / model.temperature + model.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row, in one pass without a shuffle; null texts score as empty ones."""
    return per_batch(
        docs.select("doc_id", "text"),
        "doc_id long, score double",
        lambda b: {"doc_id": b.column("doc_id"), "score": score_texts(b.column("text"), model)},
    )
