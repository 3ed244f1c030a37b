"""Hard negatives of anchor vectors by exact integer scores from a residue number system.

Components are integers, so an inner product is one too. For each of several small primes the component
matrices are taken modulo the prime (centred around zero) and multiplied in float32; sums of up to
``DIMENSIONS`` products stay below 2^24 and are exact. Chinese remaindering of the residues, shifted by
half the product of the primes, gives the exact signed score; as many primes are taken as the norms of
the two blocks ask for.

Anchors in blocks are held against all rows in slices. A task keeps a few rows per anchor of what it saw,
windows choose among those. Two rounds: the positives of every anchor, then for each positive the
negatives whose scores lie in the positive's window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import cut_lineage, per_batch, per_group, record

#: Primes below 256, largest first; nine of them hold any score of 63 bits.
PRIMES = [p for p in range(255, 150, -1) if all(p % q for q in range(2, 16))]
#: Products of two centred residues that sum up exactly in float32.
DIMENSIONS = (1 << 24) // (PRIMES[0] // 2) ** 2
#: Rows of a slice, anchors of a block, slices that meet all blocks in one cell, blocks whose finds a task holds.
SLICE_ROWS, BLOCK_ROWS, CELL_SLICES, HELD_BLOCKS = 4096, 512, 8, 32
#: Squared norm up to which every score fits into 64 bits.
LONGEST = float(1 << 62)


def primes_for(bound: float) -> list[int]:
    """As many primes as scores between -bound and bound need, three at least."""
    n, product = 3, math.prod(PRIMES[:3])
    while product <= 2 * bound + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p``, between -p/2 and p/2, as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, matrices of whole numbers in double precision, as 64-bit integers."""
    norm = lambda x: math.sqrt((x * x).sum(1).max(initial=0.0))
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    primes = primes_for(norm(a) * norm(b) * 1.001 + 1)
    half = (math.prod(primes) - 1) // 2
    for p in primes:
        rest = np.full((len(a), len(b)), half % p, np.int32)
        for lo in range(0, a.shape[1], DIMENSIONS):
            part = residues(a[:, lo : lo + DIMENSIONS], p) @ residues(b[:, lo : lo + DIMENSIONS], p).T
            rest = (rest + part.astype(np.int32)) % p
        # the next digit in mixed radix; only the last addition may pass 64 bits, and the shift takes it back
        digit = (rest - value % p) * pow(product % p, -1, p) % p if product > 1 else rest
        value = value + digit.astype(np.int64) * np.uint64(product % (1 << 64)).astype(np.int64)
        product *= p
    return value - np.uint64(half % (1 << 64)).astype(np.int64)


def first_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` first rows of each key by higher score, then smaller id, in that order."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order)))) < k]


def best_cells(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` first allowed cells of each row, ties to the smaller id."""
    low = np.iinfo(np.int64).min
    open_ = np.where(allowed, score, low)
    if score.shape[1] > k:
        edge = np.partition(open_, score.shape[1] - k, 1)[:, score.shape[1] - k]
        allowed = allowed & (open_ >= edge[:, None])
    row, column = np.nonzero(allowed)
    keep = first_of(row, score[row, column], ids[column], k)
    return row[keep], column[keep]


PACKED = "dim int, salt int, ids binary, labels binary, wide boolean, vectors binary"


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of each vector's components, end to end, and the vectors' lengths."""
    flat = column.flatten() if hasattr(column, "flatten") else column.combine_chunks().flatten()
    return np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * 256), np.asarray(column.value_lengths())


def _bytes(x: np.ndarray) -> tuple[bool, bytes]:
    """Whole numbers in four bytes each where these hold them exactly."""
    wide = bool(np.abs(x).max(initial=0) >= 1 << 24)
    return wide, (x if wide else x.astype(np.float32)).tobytes()


def _matrix(wide: bool, body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, np.float64 if wide else np.float32).astype(np.float64).reshape(n, -1)


def slices(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, embedding) packed: records of at most ``SLICE_ROWS`` rows of one dimension."""

    def work(batch: pa.RecordBatch) -> dict:
        x, dims = _whole(batch.column("embedding"))
        first = np.concatenate([[0], np.cumsum(dims)])
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        out: dict = {c: [] for c in ("dim", "salt", "ids", "labels", "wide", "vectors")}
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            y = x[first[own][:, None] + np.arange(dim)]
            fits = (y * y).sum(1) < LONGEST
            own, y = own[fits], y[fits]
            for lo in range(0, len(own), SLICE_ROWS):
                part = own[lo : lo + SLICE_ROWS]
                wide, body = _bytes(y[lo : lo + SLICE_ROWS])
                at = int(ids[part[0]]) & 0x7FFFFFFF
                for c, v in (("dim", dim), ("salt", at), ("ids", ids[part].tobytes()), ("labels", labels[part].tobytes()), ("wide", wide), ("vectors", body)):
                    out[c].append(v)
        return out

    return per_batch(rows, PACKED, work)


BLOCKS = "dim int, block int, anchors binary, ids binary, labels binary, windows binary, wide boolean, vectors binary"


def _blocks(anchors: DataFrame, cells: int, pad: int) -> DataFrame:
    """``anchors`` (anchor, vec_id, label, embedding, block, windows) as one record per dimension and block, copied to every cell.

    ``windows`` is a list of `pad` pairs (lowest, highest score), one after the other.
    """

    def work(rows: pa.Table) -> dict:
        column = lambda c: rows[c].combine_chunks()
        x, dims = _whole(column("embedding"))
        y = x.reshape(len(dims), -1) if dims[0] else np.zeros((len(dims), 0))
        fits = (y * y).sum(1) < LONGEST
        wide, body = _bytes(y[fits])
        number = lambda c: [rows[c].to_numpy()[fits].tobytes()]
        windows = column("windows").flatten().to_numpy().reshape(len(dims), 2 * pad)[fits]
        return {"dim": [int(dims[0])], "block": [rows["block"][0].as_py()], "anchors": number("anchor"), "ids": number("vec_id"), "labels": number("label"),
                "windows": [windows.tobytes()], "wide": [wide], "vectors": [body]}

    packed = per_group(anchors.withColumn("dim", F.size("embedding")), ["dim", "block"], BLOCKS, work)
    return packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))


FOUND = "anchor long, window int, vec_id long, score long"


def _against(blocks: DataFrame, packed: DataFrame, k: int, choose: Callable) -> DataFrame:
    """FOUND rows: of what each task saw, the ``k`` first rows of each anchor and window.

    ``choose(scores, block, ids, labels)`` gives (window, anchor's place, row's place) of a slice's finds.
    """
    side = ("ids", "labels", "wide", "vectors")
    blocks = blocks.select("dim", "salt", "block", "anchors", "windows", *(F.col(c).alias(f"a_{c}") for c in side))
    joined = packed.join(blocks, ["dim", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for anchor, window, ids, score in held.values():
                yield record({"anchor": anchor, "window": window, "vec_id": ids, "score": score}, FOUND)
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                long = lambda c: np.frombuffer(get(c), np.int64)  # noqa: E731, B023
                anchors, ids = long("anchors"), long("ids")
                if not len(anchors):
                    continue
                block = {"ids": long("a_ids"), "labels": long("a_labels"), "windows": long("windows").reshape(len(anchors), -1, 2)}
                score = scores(_matrix(get("a_wide"), get("a_vectors"), len(anchors)), _matrix(get("wide"), get("vectors"), len(ids)))
                window, i, j = choose(score, block, ids, long("labels"))
                new = (anchors[i], window, ids[j], score[i, j])
                key = (get("dim"), get("block"))
                if key in held:
                    new = tuple(np.concatenate(x) for x in zip(held[key], new))
                    keep = first_of(np.unique(new[0], return_inverse=True)[1] * 64 + new[1], new[3], new[2], k)
                    new = tuple(x[keep] for x in new)
                held[key] = new
                if len(held) > HELD_BLOCKS:
                    yield from flush()
        yield from flush()

    return joined.mapInArrow(run, FOUND)


def usable(embedding: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor row of ``vectors`` (vec_id, label, embedding).

    A component x counts as floor(256 x); a score is the inner product of these with the anchor's. A higher
    score comes first, then the smaller id. An anchor's positives are the first ``positives`` other rows of
    its label; for each, the first ``negatives`` rows of other labels are returned whose score is between
    ``low`` and ``high`` percent of the positive's, from rank 1. Where there are fewer, all are taken; a
    positive of negative score has none.

    Rows without id, label or vector, with a null or non-finite component, or with components so large that
    a score may pass 64 bits (squared norm of 2^62), take no part. Vectors of different length never meet.
    Every row counts, so repeated rows are others of each other, and a repeated anchor repeats its result.
    Other columns are ignored.

    Scores are taken of every anchor with every row; a block of anchors meets a slice of rows in a task.
    """
    if positives > 32:
        raise ValueError("at most 32 positives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("embedding"), is_anchor.alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    packed = cut_lineage(slices(rows.select("vec_id", "label", "embedding")), "slices")
    cells = max(1, math.ceil(packed.count() / CELL_SLICES))
    packed = packed.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(cells)).cast("int"))
    # repeated anchors are searched once
    anchors = rows.where("is_anchor").groupBy("vec_id", "label", "embedding").agg(F.count("*").alias("copies"))
    anchors = cut_lineage(anchors.withColumn("anchor", F.xxhash64("vec_id", "label", "embedding")), "anchors")
    n_blocks = max(1, math.ceil(anchors.count() / BLOCK_ROWS))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int"))

    def same(score: np.ndarray, block: dict, ids: np.ndarray, labels: np.ndarray):
        i, j = best_cells(score, block["labels"][:, None] == labels[None, :], ids, positives + 1)
        return np.zeros(len(i), np.int64), i, j

    def other(score: np.ndarray, block: dict, ids: np.ndarray, labels: np.ndarray):
        differs = block["labels"][:, None] != labels[None, :]
        out = []
        for w in range(positives):
            least, most = block["windows"][:, w, 0, None], block["windows"][:, w, 1, None]
            i, j = best_cells(score, differs & (score >= least) & (score <= most), ids, negatives)
            out.append((np.full(len(i), w), i, j))
        return tuple(np.concatenate(x) for x in zip(*out))

    none = F.array_repeat(F.lit(0).cast("long"), 2)
    met = _against(_blocks(anchors.withColumn("windows", none), cells, 1), packed, positives + 1, same)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    near = met.withColumn("place", place("anchor")).where(F.col("place") <= positives + 1)
    # of the rows with the anchor's id and its score with itself one is the anchor
    own = anchors.select("anchor", F.col("vec_id").alias("anchor_id"), "copies", F.aggregate("embedding", F.lit(0).cast("decimal(38,0)"), _plus_square).alias("itself"))
    near = near.join(own, "anchor").withColumn("twin", (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("itself")))
    self_place = F.min(F.when(F.col("twin"), F.col("place"))).over(Window.partitionBy("anchor"))
    near = near.withColumn("self", self_place).where("self IS NULL OR place <> self")
    near = near.withColumn("window", (F.col("place") - F.when(F.col("place") > F.col("self"), 2).otherwise(1)).cast("int")).where(F.col("window") < positives)
    chosen = cut_lineage(near.select("anchor", "anchor_id", "copies", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # lowest and highest score as whole numbers; an empty window where there is no such positive
    spread = chosen.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("of"))
    ends = []
    for w in range(positives):
        s = F.col("of")[w].cast("decimal(38,0)")
        ends.append(F.coalesce(F.ceil(s * low / 100).cast("long"), F.lit(1)))
        ends.append(F.coalesce(F.floor(s * high / 100).cast("long"), F.lit(0)))
    windows = anchors.join(spread, "anchor").withColumn("windows", F.array(*ends)).drop("of")
    found = _against(_blocks(windows, cells, positives), packed, negatives, other)
    ranked = found.withColumn("rank", place("anchor", "window")).where(F.col("rank") <= negatives)
    out = chosen.join(ranked, ["anchor", "window"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _plus_square(total: Column, x: Column) -> Column:
    whole = F.floor(x.cast("double") * 256).cast("decimal(19,0)")
    return (total + whole * whole).cast("decimal(38,0)")
