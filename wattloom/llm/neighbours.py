"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by three rounds of random signs and Hadamard transforms and hashed to the signed
axis it lies nearest to; in large tables a cell is a pair of such axes. Several turns give as many
tables; a query looks into its nearest cells of each table, and what it meets there is ranked by the
exact inner product. How many tables and cells that takes is measured with a few pilot queries.

Largest inner product becomes nearest direction within ranges of norm, one for each power of two: each
has its own cells and probes, every query searches every range, and the exact ranking merges them.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import collect_rows, cut_lineage, per_batch, record
from wattloom.llm.words import mix

#: Numbers of tables to choose from, and what sets the turns of the second polytope apart.
TABLES, SECOND = (1, 2, 4, 8, 16, 24), 1 << 16
#: Vectors that a cell should hold, products that sending a vector is worth.
CELL_ROWS, SEND = 256, 32
#: Vectors of a block, bytes of vectors that one task gathers, numbers that a slice of queries holds.
BLOCK_ROWS, TASK_BYTES, SLICE = 16_384, 32 << 20, 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + table)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the power of two below each norm; zero vectors stay zero."""
    peak = np.maximum(np.abs(x).max(1, initial=0), 5e-324)
    x = x / peak[:, None]
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    return x / norm[:, None], np.floor(np.log2(peak) + np.log2(norm)).astype(np.int64)


class Index:
    """What hashing needs: the vectors' dimension, and the axes of the second polytope (0: there is none).

    A cell is the signed axis that a turned vector lies nearest to, next to the same for another turn of
    which only the first ``second`` axes are looked at.
    """

    def __init__(self, dim: int, second: int = 0):
        self.dim, self.second = dim, second
        self.width = 1 << dim.bit_length()  # the first power of two above the dimension
        self.size = 2 * self.width * max(2 * second, 1)  # cells of one table

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x
        return out

    def _signed(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Scores of the signed axes of a table's polytopes for padded vectors."""
        turns = [turned(x, table)] + ([turned(x, table + SECOND)[:, : self.second]] if self.second else [])
        return [np.stack([y, -y], 2).reshape(len(y), -1) for y in turns]

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        """The cell of each padded vector in one table."""
        first, *more = (s.argmax(1) for s in self._signed(x, table))
        return first * 2 * self.second + more[0] if more else first

    def cells(self, x: np.ndarray, tables: int) -> np.ndarray:
        """The cell of each unit vector in each table."""
        x = self.padded(x)
        return np.stack([t * self.size + self.cell(x, t) for t in range(tables)], 1)

    def scores(self, x: np.ndarray, table: int) -> np.ndarray:
        """How near each cell of a table lies to each padded vector: the sum over its axes."""
        first, *more = self._signed(x, table)
        return (first[:, :, None] + more[0][:, None, :]).reshape(len(x), -1) if more else first

    def probes(self, x: np.ndarray, tables: int, probes: int) -> np.ndarray:
        """The cells each query, a unit vector, looks into: the ``probes`` nearest of each table."""
        x = self.padded(x)
        if probes >= self.size:
            return np.tile(np.arange(tables * self.size), (len(x), 1))
        return np.hstack([np.argpartition(-self.scores(x, t), probes - 1, 1)[:, :probes] + t * self.size for t in range(tables)])


def usable(embedding: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


SENT = "part long, block binary, place binary, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def _sent(blocks: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, parts: int) -> dict:
    """What goes to each task: the blocks with the places of their rows, and each row once, as byte strings."""
    part = (mix(blocks.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((rows, part))
    first = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    runs = np.split(order, first[1:]) if len(order) else []
    once = [np.unique(rows[r], return_inverse=True) for r in runs]
    return {
        "part": [int(part[r[0]]) for r in runs],
        "block": [blocks[r].tobytes() for r in runs],
        "place": [back.astype(np.int64).tobytes() for _, back in once],
        "ids": [ids[own].tobytes() for own, _ in once],
        "vectors": [x[own].tobytes() for own, _ in once],
    }


def _gathered(table: pa.Table, dim: int, kind: str) -> tuple[np.ndarray, ...]:
    """(block, place, ids, vectors) of all that was sent to a task."""
    whole = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    sizes = np.array([len(b) // 8 for b in table["ids"].to_pylist()])
    runs = np.array([len(b) // 8 for b in table["place"].to_pylist()])
    shift = np.repeat(np.cumsum(sizes) - sizes, runs)
    return whole("block", np.int64), whole("place", np.int64) + shift, whole("ids", np.int64), whole("vectors", kind).reshape(-1, dim)


def _top(slot: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each slot, each id once with its best score, ties to the smaller id."""
    order = np.lexsort((-score, ids, slot))
    s, v = slot[order], ids[order]
    order = order[np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])][: len(s)]]
    order = order[np.lexsort((ids[order], -score[order], slot[order]))]
    s = slot[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def rank_part(left: tuple, right: tuple, k: int) -> dict:
    """For each query the ``k`` best by exact inner product among the rows of the blocks it looks into.

    Of equal vectors in a block only the ``k + 1`` smallest ids can be among a query's best.
    """
    block, place, ids, x = left
    q_block, q_place, q_ids, q = right
    _, kind = np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids[place], kind[place], block))
    block, place = block[order], place[order]
    new = np.r_[True, (block[1:] != block[:-1]) | (kind[place][1:] != kind[place][:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    keep = np.arange(len(new)) - start <= k
    block, place = block[keep], place[keep]
    order = np.argsort(q_place, kind="stable")
    q_block, q_place = q_block[order], q_place[order]
    lo, hi = np.searchsorted(block, q_block, "left"), np.searchsorted(block, q_block, "right")
    edge = np.searchsorted(q_place, np.arange(len(q) + 1))
    out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
    for i in range(len(q)):
        runs = [place[a:z] for a, z in zip(lo[edge[i] : edge[i + 1]], hi[edge[i] : edge[i + 1]]) if a < z]
        if not runs:
            continue
        seen = np.unique(np.concatenate(runs))
        seen = seen[ids[seen] != q_ids[i]]
        own = q[i].astype(np.float64)
        rough = x[seen].astype(np.float64) @ own
        if len(seen) > k:
            # an id may stand in several rows, so the bound is on distinct ids only where all are distinct
            slack = 1e-9 * (np.abs(own).sum() * max(np.abs(x[seen]).max(), 1e-300))
            ranked = rough if len(np.unique(ids[seen])) == len(seen) else rough[_top(np.zeros(len(seen), np.int64), ids[seen], rough, k)]
            seen = seen[rough >= np.partition(ranked, -min(k, len(ranked)))[-min(k, len(ranked))] - slack]
        exact = (x[seen].astype(np.float64) * own).sum(1)
        best = _top(np.zeros(len(seen), np.int64), ids[seen], exact, k)
        out[0].append(np.full(len(best), q_ids[i]))
        out[1].append(ids[seen][best])
        out[2].append(exact[best])
    return dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out)))


def _pilots(rows: DataFrame, queries: DataFrame, dim: int, kind: str, k: int, pilots: int):
    """(queries, neighbours, the query of each neighbour): ``pilots`` queries drawn by a hash of their ids, searched by brute force."""
    asked = collect_rows(queries.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pilots).select("vec_id", "embedding"))
    q, q_ids = _matrix(asked["embedding"], dim, "f8"), asked["vec_id"].to_numpy()

    def best(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("embedding"), dim, "f8"), batch.column("vec_id").to_numpy()
            score = np.where(ids == q_ids[:, None], -np.inf, q @ x.T)
            near = np.argpartition(-score, min(k, len(ids)) - 1, 1)[:, :k]
            slot, found = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            fine = score[slot, found] > -np.inf
            new = (slot[fine], ids[found[fine]], score[slot[fine], found[fine]])
            held = tuple(np.concatenate(pair) for pair in zip(held, new))
            top = _top(*held, k)
            held = tuple(h[top] for h in held)
        yield record(dict(zip(("slot", "vec_id", "score"), held)), "slot long, vec_id long, score double")

    top = rows.mapInArrow(best, "slot long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    top = top.withColumn("place", place).where(F.col("place") <= k).select("slot", "vec_id")
    # pilots x k rows of two numbers
    near = collect_rows(rows.join(F.broadcast(top), "vec_id").groupBy("slot", "vec_id").agg(F.first("embedding").alias("embedding")))
    return q, _matrix(near["embedding"], dim, "f8"), near["slot"].to_numpy()


class Effort(NamedTuple):
    tables: int
    probes: dict  # norm range -> cells of each table that a query looks into


def choose(q: np.ndarray, x: np.ndarray, slot: np.ndarray, index: Index, sizes: dict, asked: int, recall: float) -> Effort:
    """The cheapest number of tables, and for each norm range the probes, at which the pilots meet ``recall`` of their neighbours.

    With as many probes as cells everything is met, so there always is one.
    """
    units, (near, level) = index.padded(directions(q)[0]), directions(x)
    near = index.padded(near)
    ranks = np.zeros((len(x), TABLES[-1]), np.int64)
    for t in range(TABLES[-1]):
        scores, cell = index.scores(units, t), index.cell(near, t)
        for at in range(0, len(x), 256):
            s = slot[at : at + 256]
            ranks[at : at + 256, t] = (scores[s] > scores[s, cell[at : at + 256]][:, None]).sum(1)
    options = []
    n = sum(sizes.values())
    for tables in TABLES:
        first = ranks[:, :tables].min(1)
        probes = {}
        for one in sizes:
            own = np.sort(first[level == one])
            if len(own):
                probes[one] = int(own[math.ceil(recall * len(own)) - 1]) + 1
        least = min(probes.values(), default=index.size)
        probes = {one: probes.get(one, least) for one in sizes}
        # products, counted once however many tables offer a vector; hashing and sending a vector is worth SEND of them
        products = asked * sum(many * min(1.0, tables * probes[one] / index.size) for one, many in sizes.items())
        sent = (n + asked) * tables + asked * sum(min(tables * probes[one], many) for one, many in sizes.items()) / 8
        options.append((products + SEND * sent, tables, probes))
    return Effort(*min(options, key=lambda o: o[:2])[1:])


def _search(rows: DataFrame, queries: DataFrame, index: Index, kind: str, n: int, k: int, effort: Effort) -> DataFrame:
    """Candidates of each query from the cells it looks into, the ``k`` best that each task saw."""
    dim, tables, stride = index.dim, effort.tables, effort.tables * index.size
    levels = np.array(sorted(effort.probes))
    probes = [effort.probes[int(one)] for one in levels]

    def count(batch: pa.RecordBatch) -> dict:
        unit, level = directions(_matrix(batch.column("embedding"), dim, "f8"))
        cell, many = np.unique(np.searchsorted(levels, level)[:, None] * stride + index.cells(unit, tables), return_counts=True)
        return {"cell": cell, "n": many}

    def looked(x: np.ndarray) -> np.ndarray:
        """The cells of each query, range by range."""
        unit = directions(x.astype(np.float64))[0]
        by = {p: index.probes(unit, tables, p) for p in set(probes)}
        return np.hstack([by[p] + i * stride for i, p in enumerate(probes)])

    def slices(batch: pa.RecordBatch):
        """A batch of queries in slices whose scores and cells stay small."""
        step = max(1, SLICE // max(index.size, tables * sum(probes)))
        x, ids = _matrix(batch.column("embedding"), dim, kind), batch.column("vec_id").to_numpy()
        for at in range(0, len(ids), step):
            yield x[at : at + step], ids[at : at + step]

    def count_asked(batch: pa.RecordBatch) -> dict:
        total = np.zeros(len(levels) * stride, np.int64)
        for x, _ in slices(batch):
            total += np.bincount(looked(x).ravel(), minlength=len(total))
        return {"cell": np.flatnonzero(total), "n": total[total > 0]}

    def per_cell(df: DataFrame, work, rows_of_block: int) -> np.ndarray:
        # at most one row per norm range and cell, bounded by max_cells whatever the number of vectors
        got = collect_rows(per_batch(df, "cell long, n long", work).groupBy("cell").agg(F.sum("n").alias("n")))
        out = np.zeros(len(levels) * stride, np.int64)
        out[got["cell"].to_numpy()] = -(-got["n"].to_numpy() // rows_of_block)
        return out

    # a cell of many vectors is cut into blocks; where many queries look into a cell its blocks have copies, each for a share of the queries
    room = max(1, TASK_BYTES // (dim * np.dtype(kind).itemsize))
    salts, copies = per_cell(rows, count, min(BLOCK_ROWS, room)), per_cell(queries, count_asked, min(BLOCK_ROWS, room))
    parts = max(1, math.ceil(n * tables / room))

    def index_rows(batch: pa.RecordBatch) -> dict:
        x, ids = _matrix(batch.column("embedding"), dim, kind), batch.column("vec_id").to_numpy()
        unit, level = directions(x.astype(np.float64))
        cells = (index.cells(unit, tables) + np.searchsorted(levels, level)[:, None] * stride).ravel()
        who = np.repeat(np.arange(len(ids)), tables)
        salt = (mix(ids[who].astype(np.uint64)) % np.maximum(salts[cells], 1).astype(np.uint64)).astype(np.int64)
        many = copies[cells]
        copy = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return _sent(np.repeat(cells << 32 | salt << 16, many) | copy, np.repeat(who, many), ids, x, parts)

    def query_rows(batches):
        for batch in batches:
            for x, ids in slices(batch) if batch.num_rows else ():
                cells = looked(x)
                who, cells = np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel()
                copy = (mix(ids[who].astype(np.uint64)) % np.maximum(copies[cells], 1).astype(np.uint64)).astype(np.int64)
                many = salts[cells]
                salt = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                yield record(_sent(np.repeat(cells << 32 | copy, many) | salt << 16, np.repeat(who, many), ids, x, parts), SENT)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([record({"query_id": [], "vec_id": [], "score": []}, FOUND)])
        return pa.Table.from_batches([record(rank_part(_gathered(left, dim, kind), _gathered(right, dim, kind), k), FOUND)])

    sent = per_batch(rows, SENT, index_rows).groupBy("part")
    return sent.cogroup(queries.mapInArrow(query_rows, SENT).groupBy("part")).applyInArrow(rank, FOUND)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.95,
    pilots: int = 128,
    max_cells: int = 1 << 19,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each query row, all candidates if there are fewer.

    Nearness is the inner product in double precision; ties go to the smaller id. A query's own id is no
    candidate. Unusable vectors, rows without id, and vectors of another length than most (the longer of
    equally many) take no part. An id in several rows counts with its best score. Queries that met fewer
    than there are candidates for look into every cell of one table, which is an exact search.

    How many tables and probes there are is measured, at every size alike: ``pilots`` queries are searched
    by brute force over all rows, and the cheapest setting is taken at which they meet the share ``recall``
    of their neighbours in each norm range. Cells grow with the table, to about ``CELL_ROWS`` vectors each,
    until there are ``max_cells`` of them, which bounds what the driver learns.
    """
    kind = "f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "f8"
    # only what is asked for, under fixed names
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("asked")).where(F.col("vec_id").isNotNull())
    rows = rows.where(usable(F.col("embedding")))
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not shape or not shape[0]["asked"]:
        empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return empty.where("false")
    dim, n, asked = shape[0]
    rows = rows.where(F.size("embedding") == dim)
    queries = rows.where("asked")

    def level_sizes(batch: pa.RecordBatch) -> dict:
        level, many = np.unique(directions(_matrix(batch.column("embedding"), dim, "f8"))[1], return_counts=True)
        return {"level": level, "n": many}

    # a power of two of a double each, so at most some two thousand
    sizes = {r["level"]: r["n"] for r in per_batch(rows, "level long, n long", level_sizes).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    axes = 2 << dim.bit_length()
    second = int(min(n / CELL_ROWS, max_cells / (TABLES[-1] * len(sizes))) / axes / 2)
    index = Index(dim, min(1 << second.bit_length() - 1, axes // 2) if second else 0)
    effort = choose(*_pilots(rows, queries, dim, kind, k, pilots), index, sizes, asked, recall)
    found = cut_lineage(_search(rows, queries, index, kind, n, k, effort), "found")
    enough = min(k, rows.select("vec_id").distinct().count() - 1)
    counts = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("met")).where(F.col("met") >= enough)
    short = queries.join(counts, queries["vec_id"] == counts["query_id"], "left_anti")
    if enough > 0 and short.head(1):
        found = found.unionByName(_search(rows, short, index, kind, n, k, Effort(1, {one: index.size for one in sizes})))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
