"""Benchmark decontamination by winnowing.

Both sides hash every run of ``GRAM`` words and keep, of every ``SPAN - GRAM + 1`` neighbouring hashes,
the smallest (the last of equals). A span of ``SPAN`` shared words holds the same hashes on both sides,
so the kept one is kept on both at the same place: no shared span is missed. Kept hashes meet in a
join and carry the words around them, over which a hit is extended word by word.

An item of fewer than ``SPAN`` words is its own only window; its fingerprint is the hash of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import collect_rows, cut_lineage, per_batch

SPAN, GRAM = 13, 7
REACH = SPAN - GRAM
CONTEXT = SPAN + REACH
#: Bits of the filter that keeps texts' fingerprints from being sent where no item can have them.
FILTER_BITS = 1 << 22

U64 = words.U64


def winnow(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of kept hashes; ``first`` bounds the texts' own hashes, and windows lie inside one text."""
    width = REACH + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    begin = words.gram_starts(first, width)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    kept = [np.zeros(0, np.int64)]
    for at in range(0, len(begin), 1 << 16):
        part = begin[at : at + (1 << 16)]
        kept.append(np.unique(part + REACH - view[part][:, ::-1].argmin(1)))
    return np.unique(np.concatenate(kept))


def _fingerprints(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes of texts, the word each begins at, and the text it is of."""
    counts = np.maximum(w.counts() - GRAM + 1, 0)
    start = words.gram_starts(w.first, GRAM)
    grams = words.gram_hash(w.hash, GRAM)[start] if len(start) else np.zeros(0, U64)
    kept = winnow(grams, np.concatenate([[0], np.cumsum(counts)]))
    return grams[kept], start[kept], np.searchsorted(w.first, start[kept], "right") - 1


def _context(w: words.Words, start: np.ndarray, text: np.ndarray, missing: int) -> np.ndarray:
    """Hashes of the ``CONTEXT`` words around each kept one; ``missing`` outside the text."""
    at = start[:, None] - REACH + np.arange(CONTEXT)
    inside = (at >= w.first[text][:, None]) & (at < w.first[text + 1][:, None])
    return np.where(inside, w.hash[np.clip(at, 0, max(len(w.hash) - 1, 0))], U64(missing))


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    return words.mix(words.gram_hash(hashes, n) ^ U64(n * 0x51ED27))


def item_fingerprints(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(fp, item_id, n, around): every item's fingerprints; ``n`` is the words of a window, ``around`` the context or empty."""

    def work(batch: pa.RecordBatch) -> dict:
        fp, owner, size, around = [], [], [], []
        for i, j, _, w in words.runs(batch.column("text"), words.ALNUM):
            counts = w.counts()
            f, start, t = _fingerprints(w)
            fp.append(f)
            owner.append(i + t)
            size.append(np.full(len(f), SPAN))
            around += [x.tobytes() for x in _context(w, start, t, 2)]
            for t in np.flatnonzero((counts > 0) & (counts < SPAN)):
                fp.append(_short(w.hash[w.first[t] : w.first[t + 1]], int(counts[t])))
                owner.append(np.array([i + t]))
                size.append(np.array([counts[t]]))
                around.append(b"")
        return {
            "fp": np.concatenate(fp),
            "item_id": batch.column("item_id").take(pa.array(np.concatenate(owner).astype(np.int64))),
            "n": np.concatenate(size).astype(np.int32),
            "around": around,
        }

    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return per_batch(items, "fp long, item_id string, n int, around binary", work).dropDuplicates()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (a hash of the text), n_words, spans (array of start and end words, distinct), items (sorted ids).

    Documents are matched by id and text, so repeated rows each get their result. Null and empty texts
    have no words and no hits; items without words match nothing; an item without id gives spans only.
    """
    items = cut_lineage(item_fingerprints(benchmark), "items")
    # at most FILTER_BITS bits and SPAN lengths, whatever the benchmark
    slot = f"pmod(fp, {FILTER_BITS})"
    bits = collect_rows(items.groupBy(F.expr(f"shiftright({slot}, 5)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({slot}, 32) AS int)))").alias("bits")))
    lengths = sorted(r.n for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())
    packed = np.zeros(FILTER_BITS // 32, np.uint32)
    packed[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    packed = packed.tobytes()

    def work(batch: pa.RecordBatch) -> dict:
        known = np.frombuffer(packed, np.uint32)

        def may(f: np.ndarray) -> np.ndarray:
            place = (f.view(np.int64) % FILTER_BITS).astype(np.int64)
            return (known[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1

        count = np.zeros(batch.num_rows, np.int64)
        got = [[] for _ in range(batch.num_rows)]
        for i, j, _, w in words.runs(batch.column("text"), words.ALNUM):
            count[i:j] = w.counts()
            f, start, t = _fingerprints(w)
            keep = np.flatnonzero(may(f))
            f, start, t = f[keep], start[keep], t[keep]
            for row, fp, at, around in zip(i + t, f.view(np.int64), start - w.first[t], _context(w, start, t, 1)):
                got[row].append((int(fp), SPAN, int(at), around.tobytes()))
            for n in lengths:
                start = words.gram_starts(w.first, n)
                f = _short(w.hash, n)[start] if len(start) else np.zeros(0, U64)
                keep = np.flatnonzero(may(f))
                f, start = f[keep], start[keep]
                t = np.searchsorted(w.first, start, "right") - 1
                for row, fp, at in zip(i + t, f.view(np.int64), start - w.first[t]):
                    got[row].append((int(fp), n, int(at), b""))
        flat = [x for row in got for x in row]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in got])]).astype(np.int32))
        fields = [pa.array([x[k] for x in flat], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
        found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["fp", "n", "at", "around"]))
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": count, "found": found}

    found_type = "array<struct<fp:long,n:int,at:long,around:binary>>"
    schema = f"doc_id long, key long, n_words long, found {found_type}"
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = work(batch)
                yield pa.RecordBatch.from_arrays([got["doc_id"], got["key"], pa.array(got["n_words"]), got["found"]], list(got))

    scanned = cut_lineage(rows.mapInArrow(run, schema), "scanned")
    candidates = scanned.where(F.size("found") > 0).select("doc_id", "key", F.explode("found").alias("h"))
    candidates = candidates.select("doc_id", "key", "h.*").dropDuplicates(["doc_id", "key", "at", "n", "fp"])
    pairs = candidates.join(items.withColumnRenamed("around", "item_around"), ["fp", "n"])
    spans = extended(pairs)
    union = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    whole = scanned.select("doc_id", "key", "n_words")
    same = whole["doc_id"].eqNullSafe(union["doc_id"]) & (whole["key"] == union["key"])
    return whole.join(union, same, "left").select(
        whole["doc_id"],
        whole["key"],
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def extended(pairs: DataFrame) -> DataFrame:
    """Joined fingerprints as (doc_id, key, item_id, start, end) of shared spans, extended word by word; too short ones go."""

    def work(batch: pa.RecordBatch) -> dict:
        n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
        long = np.flatnonzero(n == SPAN)
        own = [np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), U64).reshape(-1, CONTEXT) for c in ("around", "item_around")]
        same = own[0] == own[1]
        left = np.minimum.accumulate(same[:, :REACH][:, ::-1], 1).sum(1)
        right = np.minimum.accumulate(same[:, -REACH:], 1).sum(1)
        core = same[:, REACH:-REACH].all(1)
        start, end, keep = at.copy(), at + n, n < SPAN
        start[long], end[long] = at[long] - left, at[long] + GRAM + right
        keep[long] = core & (left + GRAM + right >= SPAN)
        keep = pa.array(np.flatnonzero(keep))
        rest = {c: batch.column(c).take(keep) for c in ("doc_id", "key", "item_id")}
        return rest | {"start": pa.array(start).take(keep), "end": pa.array(end).take(keep)}

    return per_batch(pairs, "doc_id long, key long, item_id string, start long, end long", work)


def covered(spans) -> Column:
    """Words in the union of an array of spans."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct((acc["total"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["reach"]))).alias("total"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    return F.aggregate(F.array_sort(spans), zero, step)["total"]


def contaminated(n_hit, n_words) -> Column:
    """The rule: some word is hit, and hits are a twentieth of all words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
