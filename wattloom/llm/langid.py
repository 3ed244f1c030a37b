"""Language identification by a byte convolutional network with max pooling, trained in numpy.

A text is read as windows of fixed length. Filters of two, three and four bytes run over a window,
the largest response of each is kept, and a softmax over them gives the window's probabilities. A
text's probabilities are the length-weighted mean log probabilities of all its windows.

A filter is a sum of one table entry per byte place. ASCII bytes are folded into 30 classes, others keep
a class of their own, so two neighbouring bytes index one table of 24,964 rows, and every filter costs
one or two lookups.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import adam, collect_rows, cut_lineage, fold, per_batch

HELD_OUT_MOD, HELD_OUT = 3, 1
WINDOW, FILTERS, CLASSES = 256, 12, 158
WIDTHS = (2, 3, 4)
#: Windows convolved at once.
BATCH = 512
UNKNOWN = "und"
LETTER = r"\p{L}"


def _classes() -> np.ndarray:
    """Byte classes: small letters (capitals folded), digits, space, other ASCII; every byte of longer characters is its own."""
    table = np.zeros(256, np.int64)
    table[33:127] = 29
    table[[9, 10, 11, 12, 13, 32]] = 1
    for i in range(26):
        table[97 + i] = table[65 + i] = 2 + i
    table[48:58] = 28
    table[128:] = np.arange(30, 158)
    return table


BYTE_CLASS = _classes()


class Model(NamedTuple):
    languages: list
    tables: dict
    weight: np.ndarray
    bias: np.ndarray


def _start(n_out: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    q = {f"f{w}_{k}": rng.normal(0, 0.5, (CLASSES, FILTERS)) for w in WIDTHS for k in range(w)}
    return q | {f"b{w}": np.zeros(FILTERS) for w in WIDTHS} | {"weight": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_out)), "bias": np.zeros(n_out)}


def _windows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (padded with class 0), the text of each, and how many bytes it holds."""
    n = np.diff(offsets)
    per = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), per)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][text] + rank * WINDOW
    held = np.minimum(n[text] - rank * WINDOW, WINDOW)
    padded = np.concatenate([codes, np.zeros(WINDOW, codes.dtype)])
    grid = padded[begin[:, None] + np.arange(WINDOW)]
    grid[np.arange(WINDOW) >= held[:, None]] = 0
    return grid, text, held


def _pair_tables(q: dict) -> dict:
    """Tables over two neighbouring classes, from the filters' tables over one."""
    pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS).astype(np.float32)
    return {
        "2": pair(q["f2_0"], q["f2_1"]) + q["b2"].astype(np.float32),
        "3": pair(q["f3_0"], q["f3_1"]) + q["b3"].astype(np.float32),
        "3x": q["f3_2"].astype(np.float32),
        "4": pair(q["f4_0"], q["f4_1"]) + q["b4"].astype(np.float32),
        "4x": pair(q["f4_2"], q["f4_3"]),
    }


def _pool(grid: np.ndarray, tables: dict) -> np.ndarray:
    """Largest response of each filter in each window."""
    two = grid[:, :-1] * CLASSES + grid[:, 1:]
    a = tables["2"][two].max(1)
    b = (tables["3"][two[:, :-1]] + tables["3x"][grid[:, 2:]]).max(1)
    c = (tables["4"][two[:, :-2]] + tables["4x"][two[:, 2:]]).max(1)
    return np.maximum(np.hstack([a, b, c]), 0)


def log_probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    """For each text the log probability of each language; even for a text without bytes."""
    out = np.zeros((len(texts), len(model.languages)))
    weight = np.zeros(len(texts))
    data, offsets = words.utf8(texts)
    for i, j in words.slices(offsets, 1 << 18):
        codes = BYTE_CLASS[data[offsets[i] : offsets[j]]]
        grid, text, held = _windows(codes, offsets[i : j + 1] - offsets[i])
        for at in range(0, len(grid), BATCH):
            z = _pool(grid[at : at + BATCH], model.tables) @ model.weight + model.bias
            z -= np.logaddexp.reduce(z, 1, keepdims=True)
            np.add.at(out, i + text[at : at + BATCH], z * held[at : at + BATCH, None])
            np.add.at(weight, i + text[at : at + BATCH], held[at : at + BATCH])
    out /= np.maximum(weight, 1)[:, None]
    return out - np.logaddexp.reduce(out, 1, keepdims=True)


def _train(grid: np.ndarray, y: np.ndarray, n_out: int, steps: int, seed: int) -> dict:
    """Stochastic gradients; only the place of each filter's largest response passes one back."""
    rng = np.random.default_rng(seed)
    share = np.bincount(y, minlength=n_out) / len(y)
    weight = 1 / np.maximum(share[y] * n_out, 1e-3)

    def grads(q: dict, _: int) -> dict:
        rows = rng.integers(0, len(y), 64)
        g, target, w = grid[rows], y[rows], weight[rows]
        got = {k: np.zeros_like(v) for k, v in q.items()}
        pooled, places = [], []
        for width in WIDTHS:
            size = WINDOW - width + 1
            r = q[f"b{width}"] + sum(q[f"f{width}_{k}"][g[:, k : k + size]] for k in range(width))
            places.append(r.argmax(1))
            pooled.append(np.take_along_axis(r, places[-1][:, None, :], 1)[:, 0, :])
        h = np.maximum(np.hstack(pooled), 0)
        z = h @ q["weight"] + q["bias"]
        p = np.exp(z - np.logaddexp.reduce(z, 1, keepdims=True))
        p[np.arange(len(rows)), target] -= 1
        d = p * w[:, None] / len(rows)
        got["weight"], got["bias"] = h.T @ d, d.sum(0)
        dh = (d @ q["weight"].T) * (h > 0)
        for i, width in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            got[f"b{width}"] = part.sum(0)
            for k in range(width):
                codes = np.take_along_axis(g, places[i] + k, 1)
                np.add.at(got[f"f{width}_{k}"], (codes, np.arange(FILTERS)[None, :]), part)
        return got

    return adam(grads, _start(n_out, seed), steps, 0.01, 1e-5)


def fit(docs: DataFrame, max_texts: int = 4000, windows_per_text: int = 6, steps: int = 900, seed: int = 5) -> Model:
    """Trains on at most ``max_texts`` texts with a language of the learning fold, up to ``windows_per_text`` windows of each.

    Every language gets an equal share of ``max_texts``, at least one text, so a rare one is learned from
    all it has; within a language texts are picked by a hash of the id. An id with several languages
    counts with the greatest. Without labelled text the model knows no language.
    """
    seen = fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & seen)
    labelled = known.select("doc_id", F.col("lang").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    labelled = cut_lineage(labelled, "labelled")
    counts = labelled.groupBy("y").agg(F.count("*").alias("n"))
    share = max(1, max_texts // max(1, counts.count()))
    # by their hash about as many ids of a language pass as are ranked, however many it has
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = labelled.join(counts, "y").where(place < F.lit(float((1 << 30) * (2 * share + 20))) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(place, "doc_id"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= share).select("doc_id", "y").limit(max_texts)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_texts rows of an id and a code

    def cut(batch: pa.RecordBatch) -> dict:
        data, offsets = words.utf8(batch.column("text"))
        grid, text, _ = _windows(BYTE_CLASS[data], offsets)
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        many = np.bincount(text, minlength=batch.num_rows)[text]
        # evenly spaced over the text
        keep = (rank * windows_per_text // np.maximum(many, 1) != (rank - 1) * windows_per_text // np.maximum(many, 1)) | (rank == 0)
        return {
            "doc_id": batch.column("doc_id").take(pa.array(text[keep])),
            "rank": rank[keep],
            "y": batch.column("y").take(pa.array(text[keep])),
            "w": [x.astype(np.uint8).tobytes() for x in grid[keep]],
        }

    got = collect_rows(per_batch(rows, "doc_id long, rank int, y string, w binary", cut).orderBy("doc_id", "rank"))
    languages = sorted(set(got["y"].to_pylist()))
    if not languages:
        return Model([], {}, np.zeros((0, 0)), np.zeros(0))
    grid = np.frombuffer(b"".join(got["w"].to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    y = np.searchsorted(languages, got["y"].to_pylist())
    q = _train(grid, y, len(languages), steps, seed)
    return Model(languages, _pair_tables(q), q["weight"], q["bias"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row over all its windows.

    A null text, or one without a letter, is `und` with score 0; so is every text if no language was learned.
    """

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        known = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
        if not model.languages:
            known = np.zeros(len(texts), bool)
            return {"doc_id": batch.column("doc_id"), "lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
        logp = log_probabilities(texts, model)
        best = logp.argmax(1)
        score = np.where(known, np.exp(logp[np.arange(len(best)), best]), 0.0)
        names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
        return {"doc_id": batch.column("doc_id"), "lang_pred": names.tolist(), "score": score}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double", work)
