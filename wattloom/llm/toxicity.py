"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other sampled text is unlabelled and may hold
toxic ones at the rate of the class prior. The risk of a scorer g with logistic loss is

    prior * mean_P loss(g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g))

and where the bracket falls below zero its gradient is taken in reverse. Inputs are the presence of
words whose share of positives exceeds their share of all texts by many standard errors, counted over
every text of the learning fold. Rare words count as well: what a word needs is that no word of the
whole vocabulary would stand among the positives so often by chance.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import adam, collect_rows, cut_lineage, fold, labelled_sample, per_batch, sigmoid

HELD_OUT_MOD, HELD_OUT = 3, 1
#: Confirmed texts that must hold a word.
LEAST = 4


class Model(NamedTuple):
    """Hashes of the words that count, sorted, and the scorers' weights and biases."""

    hashes: np.ndarray
    weights: np.ndarray
    biases: np.ndarray


def _presence(texts: pa.Array, hashes: np.ndarray):
    """(first text, last text, text index, feature index) of the distinct known words, by slices."""
    mask = np.zeros(1 << 16, bool)
    mask[(hashes & words.U64(0xFFFF)).astype(np.int64)] = True
    for i, j, _, w in words.runs(texts, words.ALNUM):
        near = np.flatnonzero(mask[(w.hash & words.U64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(hashes, w.hash[near])
        at[at == len(hashes)] = 0
        hit = hashes[at] == w.hash[near] if len(hashes) else np.zeros(0, bool)
        text = np.searchsorted(w.first, near[hit], "right") - 1
        pairs = np.unique(text * max(len(hashes), 1) + at[hit])
        yield i, j, pairs // max(len(hashes), 1), pairs % max(len(hashes), 1)


def _fold(docs: DataFrame, labels: DataFrame, max_labels: int, max_unlabelled: int) -> DataFrame:
    """(text, p, u) of every text of the learning fold: whether it is confirmed toxic (p = 1) and drawn for the plain sample (u = 1).

    A confirmed text that is also drawn for the plain sample counts in both, else the class prior
    would not hold for the unlabelled side.
    """
    seen = fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT
    lab = labelled_sample(labels, "toxic", seen, max_labels)
    known = lab.where("y = 1").select("doc_id", F.lit(1).alias("p"))
    n = docs.select("doc_id").count()
    share = min(1.0, max_unlabelled / max(n, 1))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))
    # the labelled side holds at most max_labels rows of two numbers
    rows = docs.select("doc_id", "text").where(seen).join(F.broadcast(known), "doc_id", "left")
    return rows.select("text", F.coalesce("p", F.lit(0)).alias("p"), part.cast("int").alias("u"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labels: int = 40_000,
    max_unlabelled: int = 12_000,
    max_words: int = 1 << 14,
    steps: int = 1500,
    scorers: int = 3,
) -> Model:
    """Trains on a bounded sample: ``max_labels`` labelled rows of the learning fold, about ``max_unlabelled`` others.

    Words are counted over all texts of the learning fold; at most ``max_words`` of those that mark a
    class become features. Labels of the held-out fold are never read. Without positives the model
    knows no word and scores the class prior.
    """
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT))
    n_seen, n_toxic = seen.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((n_toxic or 0) / max(n_seen, 1), 1e-3), 0.5)
    texts = _fold(docs, labels, max_labels, max_unlabelled)
    sample = texts.where("p = 1 OR u = 1")

    def count(batch: pa.RecordBatch) -> dict:
        p = batch.column("p").to_numpy()
        held = []
        for i, j, _, w in words.runs(batch.column("text"), words.ALNUM):
            if not len(w.hash):
                continue
            owner = w.owner()
            order = np.lexsort((owner, w.hash))
            h, o = w.hash[order], owner[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
            h, o = h[new], o[new]
            # a slice leaves one row per word, not one per word and text
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held.append((h[first], np.add.reduceat(p[i:j][o].astype(np.int64), first), np.diff(np.append(first, len(h)))))
        if not held:
            return None
        h, n_toxic, n_all = (np.concatenate(x) for x in zip(*held))
        h, back = np.unique(h, return_inverse=True)
        return {"h": h, "np": np.bincount(back, n_toxic, len(h)).astype(np.int64), "nu": np.bincount(back, n_all, len(h)).astype(np.int64)}

    # np: positives that hold the word; nu: all texts that do
    by_word = per_batch(texts, "h long, np long, nu long", count).groupBy("h").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    n_p, n_drawn, n_u = texts.agg(F.sum("p"), F.sum("u"), F.count("*")).first()
    if not n_p or not n_drawn:
        return Model(np.zeros(0, words.U64), np.zeros((1, 0), np.float32), np.array([np.log(prior / (1 - prior))]))
    by_word = cut_lineage(by_word.where("np > 0"), "words")
    share = F.lit(n_p / n_u)
    z = (F.col("np") - F.col("nu") * share) / F.sqrt(F.col("nu") * share * (1 - share) + 1e-12)
    # log likelihood ratio against "as often as in any text"; the best of V words comes to about log V by chance
    rest = F.col("nu") - F.col("np")
    chance = F.col("np") * F.log(F.col("np") / (F.col("nu") * share)) + F.when(rest > 0, rest * F.log(rest / (F.col("nu") * (1 - share)))).otherwise(0)
    tried = by_word.where(F.col("nu") >= LEAST).count()
    marking = by_word.withColumn("z", z).where((F.col("np") >= LEAST) & (F.col("np") / n_p > 3 * F.col("nu") / n_u) & (chance > math.log(max(tried, 1))))
    rows = collect_rows(marking.orderBy(F.desc("z"), "h").limit(max_words).select("h"))
    hashes = np.sort(rows["h"].to_numpy().view(np.uint64))
    k = len(hashes)

    def features(batch: pa.RecordBatch) -> dict:
        got = [np.zeros(0, np.int64)] * batch.num_rows
        for i, _, text, feature in _presence(batch.column("text"), hashes):
            owners, first = np.unique(text, return_index=True)
            for t, f in zip(owners, np.split(feature, first[1:])):
                got[i + t] = f
        return {"p": batch.column("p"), "u": batch.column("u"), "f": [x.astype(np.int32).tolist() for x in got]}

    # equal rows carry the same gradient, so patterns and their counts are enough
    seen_rows = per_batch(sample, "p int, u int, f array<int>", features).groupBy("p", "u", "f").count()
    rows = collect_rows(seen_rows.orderBy(F.desc("count"), "p", "u", "f").limit(max_labels + max_unlabelled))
    n = rows["count"].to_numpy().astype(float)
    lists = rows["f"].to_pylist()
    p, u = np.flatnonzero(rows["p"].to_numpy() == 1), np.flatnonzero(rows["u"].to_numpy() == 1)
    xp, xu = (Presence([lists[i] for i in which], k) for which in (p, u))
    return _train(xp, n[p], xu, n[u], prior, hashes, steps, scorers)


class Presence:
    """A sparse table of zeros and ones, row by row the columns that are one."""

    def __init__(self, lists: list, width: int):
        self.rows = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
        self.columns = np.concatenate([np.zeros(0, np.int64), *(np.array(f, np.int64) for f in lists)])
        self.shape = (len(lists), width)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.shape[0])

    def under(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights[self.rows], self.shape[1])


def _train(xp: Presence, np_, xu: Presence, nu, prior, hashes, steps, scorers) -> Model:
    wp, wu = np_ / np_.sum(), nu / nu.sum()
    all_w, all_b = [], []
    for seed in range(scorers):
        rng = np.random.default_rng(seed)
        start = {"w": rng.normal(0, 0.05, xp.shape[1]), "b": np.zeros(1)}

        def grads(q: dict, _: int) -> dict:
            gp, gu = xp.times(q["w"]) + q["b"], xu.times(q["w"]) + q["b"]
            rest = wu @ np.logaddexp(0, gu) - prior * (wp @ np.logaddexp(0, gp))
            dp, dn, du = -prior * wp * sigmoid(-gp), -prior * wp * sigmoid(gp), wu * sigmoid(gu)
            if rest < 0:  # the bracket has overfitted: climb back
                dp, dn, du = 0 * dp, -dn, -du
            return {"w": xp.under(dp + dn) + xu.under(du), "b": np.array([(dp + dn).sum() + du.sum()])}

        got = adam(grads, start, steps, 0.2, 1e-5)
        all_w.append(got["w"])
        all_b.append(got["b"][0])
    return Model(hashes, np.array(all_w, np.float64), np.array(all_b))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Mean probability of the scorers for each text; null and empty texts hold no word."""
    total = np.zeros((len(model.biases), len(texts))) + model.biases[:, None]
    if len(model.hashes):
        for i, _, text, feature in _presence(texts, model.hashes):
            for s in range(len(total)):
                np.add.at(total[s], i + text, model.weights[s][feature])
    return sigmoid(total).mean(axis=0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row, in one pass without a shuffle."""
    return per_batch(
        docs.select("doc_id", "text"),
        "doc_id long, score double",
        lambda b: {"doc_id": b.column("doc_id"), "score": score_texts(b.column("text"), model)},
    )


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(score_texts(batch.column(at), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
