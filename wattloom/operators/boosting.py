"""Gradient boosting on all rows of a table.

Spark finds the bins of every feature and reduces the rows to cells: rows that fall into the same bins (and
the same tenth or so of the rows, see ``BUCKETS``) have the same features to every tree, so their number and
the sum of their labels stand for them. Quantile losses need the labels' order too; their cells are also cut
by the label's bin, and a cell's mean label stands for its rows.

Cells are packed into blocks. A model grows by questions to all blocks, each answered by a small array per
block: sums by node, feature and bin for a level of splits, counts by leaf and part of a range for leaf
quantiles. Where the table makes one block, the questions are answered in the task that has it, all models
side by side. Beyond that each question of all models is one Spark job; the arrays are added up by Spark, the
driver sees one per model, and what the trees so far predict is written into the blocks every few rounds. No
row and no cell reaches the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators import trees
from wattloom.session import cut_lineage

#: Bins of a feature, and of the label under a quantile loss.
BINS, LABEL_BINS = 64, 256
#: Rows are dealt into so many buckets by their keys; a round leaves whole buckets out.
BUCKETS = 20
#: Cells of a block: 2^18 take some 12 MB.
BLOCK_CELLS = 1 << 18
#: Rounds after which blocks are written anew with the predictions so far.
REWRITE = 25
#: Parts into which the range of a leaf's residuals is cut when a quantile is sought.
PARTS = 256


@dataclass(frozen=True)
class Spec:
    """A model to fit: loss (squared, or the pinball loss of ``quantile``), size, and the parts of the rows it learns from and is measured on."""

    quantile: float | None = None
    rounds: int = 350
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.85
    columns: float = 0.85
    least: int = 1
    seed: int = 42
    learn: int = 0
    check: int | None = None


@dataclass
class Fitted:
    """A fitted model, and its root mean squared error on the part it was measured on."""

    model: trees.Ensemble
    rmse: float | None


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Thresholds between the values of each column, at quantiles over all rows where there are many."""
    value = lambda c: F.col(f"`{c}`").cast("double")
    shares = [k / (bins - 1) for k in range(bins)]
    row = df.agg(*[F.percentile_approx(value(c), shares, 10_000) for c in columns], *[F.approx_count_distinct(value(c)) for c in columns]).first()
    few = [k for k in range(len(columns)) if row[len(columns) + k] <= 2 * bins]
    # at most some hundred values per column
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(columns[k]).alias("v")) for k in few])).alias("x")).select("x.*").distinct() if few else None
    values: dict[int, list[float]] = {}
    for k, v in each.collect() if few else []:
        values.setdefault(k, []).append(v)
    out = []
    for k in range(len(columns)):
        own = np.unique(np.array(values.get(k) if len(values.get(k, [])) in range(1, bins + 1) else row[k] or [], float))
        out.append((own[:-1] + own[1:]) / 2)
    return out


def cells(df: DataFrame, columns: list[str], label: str, keys: list[str], part: Column, edges: list[np.ndarray], label_edges: np.ndarray | None) -> DataFrame:
    """(key, n, s, ss): number, sum and sum of squares of the labels of the rows in each cell.

    The key is a byte each for part, bucket, the features' bins and, with ``label_edges``, the label's bin.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rows = df.select(part.cast("int").alias("_part"), bucket.cast("int").alias("_bucket"), *[F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(columns)], F.col(f"`{label}`").cast("double").alias("_y"))
    n_columns = len(columns)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("_y").to_numpy()
            parts = [batch.column("_part").to_numpy(), batch.column("_bucket").to_numpy()]
            parts += [np.searchsorted(edges[k], batch.column(f"_x{k}").to_numpy(), "left") for k in range(n_columns)]
            if label_edges is not None:
                parts.append(np.searchsorted(label_edges, y, "left"))
            key = np.ascontiguousarray(np.stack(parts, 1).astype(np.uint8))
            whole, back = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True)
            add = lambda w: np.bincount(back, w, len(whole))  # noqa: B023, E731
            sums = [add(None), add(y), add(y * y)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in whole], pa.binary()), pa.array(sums[0], pa.int64()), pa.array(sums[1]), pa.array(sums[2])], ["key", "n", "s", "ss"])

    some = rows.dropna().mapInArrow(reduce, "key binary, n long, s double, ss double")
    return some.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))


class Block:
    """Cells as arrays, and what each model predicts for them after some of its trees."""

    def __init__(self, keys: bytes, n: bytes, s: bytes, ss: bytes, n_columns: int, held: bytes | None = None, bases: list[int] | None = None):
        self.n, self.s, self.ss = np.frombuffer(n, np.int64), np.frombuffer(s), np.frombuffer(ss)
        table = np.frombuffer(keys, np.uint8).reshape(len(self.n), -1)
        self.part, self.bucket = table[:, 0], table[:, 1]
        self.bins = np.ascontiguousarray(table[:, 2 : 2 + n_columns].T)
        self.mean = self.s / self.n
        self.held: dict[int, tuple[np.ndarray, int]] = {}
        if held:
            self.held = {k: x for k, x in enumerate(zip(np.frombuffer(held).reshape(-1, len(self.n)), bases)) if x[1]}

    def nodes(self, splits: dict[int, tuple[int, int]], rows: np.ndarray) -> np.ndarray:
        """The node of each of ``rows``; children of k are 2k + 1 and 2k + 2."""
        node = np.zeros(len(rows), np.int64)
        for k in sorted(splits):
            f, cut = splits[k]
            mine = np.flatnonzero(node == k)
            node[mine] = 2 * k + 1 + (self.bins[f][rows[mine]] > cut)
        return node

    def predicted(self, number: int, grown: Grown) -> np.ndarray:
        """Predictions of model ``number``; trees that were not applied yet are."""
        now, done = self.held.get(number, (None, 0))
        if now is None:
            now = np.full(len(self.n), grown.start)
        if done < grown.base + len(grown.trees):
            now, every = now.copy(), np.arange(len(self.n))
            for splits, steps in grown.trees[max(0, done - grown.base) :]:
                now += steps[self.nodes(splits, every)]
            self.held[number] = (now, grown.base + len(grown.trees))
        return now


@dataclass
class Grown:
    """What blocks have to know of a model: its start, its trees after the first ``base``, and what it is."""

    spec: Spec
    start: float
    trees: list
    base: int = 0


@dataclass
class Question:
    """What a model asks of every block; ``kind`` names the method of :class:`Answers`."""

    kind: str
    splits: dict
    skip: tuple = ()
    nodes: tuple = ()
    columns: tuple = ()
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Answers:
    """Answers of one block: (sums, least, largest) arrays that add up over blocks, the last two by min and max."""

    def __init__(self, block: Block, number: int, grown: Grown, ask: Question):
        self.block, self.spec, self.ask = block, grown.spec, ask
        self.now = block.predicted(number, grown)
        part = grown.spec.check if ask.kind == "error" else grown.spec.learn
        use = block.part == part
        if ask.skip:
            use &= ~np.isin(block.bucket, ask.skip)
        self.rows = np.flatnonzero(use)
        self.residual = block.mean[self.rows] - self.now[self.rows]

    def total(self):
        """Rows, sum of labels."""
        return np.array([self.block.n[self.rows].sum(), self.block.s[self.rows].sum()], float), None, None

    def error(self):
        """Rows, sum of squared errors."""
        r, now = self.rows, self.now[self.rows]
        return np.array([self.block.n[r].sum(), (self.block.ss[r] - 2 * now * self.block.s[r] + self.block.n[r] * now * now).sum()]), None, None

    def level(self):
        """Gradient sums and rows by node of the level, column and bin."""
        b, q = self.block, self.spec.quantile
        node = b.nodes(self.ask.splits, self.rows)
        place = np.full(max(self.ask.nodes) + 2, -1)
        place[list(self.ask.nodes)] = np.arange(len(self.ask.nodes))
        at = place[np.minimum(node, len(place) - 1)]
        live = at >= 0
        rows, at = self.rows[live], at[live]
        n = b.n[rows].astype(float)
        g = n * (self.residual[live] if q is None else np.where(self.residual[live] >= 0, q, q - 1.0))
        out = np.zeros((2, len(self.ask.nodes), len(self.ask.columns), BINS))
        for c, f in enumerate(self.ask.columns):
            slot = at * BINS + b.bins[f][rows]
            for k, w in enumerate((g, n)):
                out[k, :, c] = np.bincount(slot, w, len(self.ask.nodes) * BINS).reshape(-1, BINS)
        return out, None, None

    def spread(self):
        """Rows, least and largest residual by leaf and part of its range."""
        ask, leaves = self.ask, len(self.ask.nodes)
        node = self.block.nodes(ask.splits, self.rows)
        place = np.full(max(ask.nodes) + 2, -1)
        place[list(ask.nodes)] = np.arange(leaves)
        at = place[np.minimum(node, len(place) - 1)]
        r, n = self.residual, self.block.n[self.rows]
        live = (at >= 0) & (r >= ask.low[at]) & (r <= ask.high[at])
        at, r, n = at[live], r[live], n[live]
        low, width = ask.low[at], (ask.high - ask.low)[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            piece = np.where(np.isfinite(width) & (width > 0), np.minimum((r - low) / width * PARTS, PARTS - 1), 0).astype(np.int64)
        slot = at * PARTS + piece
        least, most = np.full(leaves * PARTS, np.inf), np.full(leaves * PARTS, -np.inf)
        np.minimum.at(least, slot, r)
        np.maximum.at(most, slot, r)
        shape = lambda x: x.reshape(leaves, PARTS)
        return shape(np.bincount(slot, n, leaves * PARTS)), shape(least), shape(most)


def answer(block: Block, number: int, grown: Grown, ask: Question):
    return getattr(Answers(block, number, grown, ask), ask.kind)()


def added(a, b):
    """Two answers as one."""
    return tuple(x if y is None else op(x, y) for op, x, y in zip((np.add, np.minimum, np.maximum), a, b))


def quantiles(splits: dict, skip: tuple, leaves: list[int], weights: list[float], share: float) -> Generator[Question, tuple, list[float]]:
    """For each leaf the least residual that ``share`` of its rows don't exceed.

    Each question cuts the ranges that are left into parts; a part's least and largest residual are the
    next range, until they are the same number.
    """
    low, high = np.full(len(leaves), -np.inf), np.full(len(leaves), np.inf)
    rank = np.maximum(1.0, np.ceil(share * np.array(weights) - 1e-9))
    while (low < high).any():
        n, least, most = yield Question("spread", splits, skip, tuple(leaves), low=low, high=high)
        before = np.cumsum(n, 1)
        piece = np.minimum((before < rank[:, None]).sum(1), PARTS - 1)
        row = np.arange(len(leaves))
        rank = rank - np.where(piece > 0, before[row, piece - 1], 0)
        low, high = least[row, piece], most[row, piece]
    return low.tolist()


def splits_of(hist: np.ndarray, nodes: list[int], columns: list[int], sizes: list[int], least: int, stats: dict) -> dict[int, tuple[int, int]]:
    """The best split of each node with any gain; ``stats`` takes the gradient and rows of nodes and children."""
    chosen = {}
    for k, node in enumerate(nodes):
        best, found = 1e-12, None
        for c, f in enumerate(columns):
            total, count = hist[0, k, c, : sizes[f] + 1], hist[1, k, c, : sizes[f] + 1]
            stats.setdefault(node, (float(total.sum()), float(count.sum())))
            if sizes[f] < 1:
                continue
            left, n_left = total.cumsum()[:-1], count.cumsum()[:-1]
            whole, n = total.sum(), count.sum()
            ok = (n_left >= least) & (n - n_left >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left**2 / n_left + (whole - left) ** 2 / (n - n_left) - whole**2 / n, -1.0)
            cut = int(gain.argmax())
            if gain[cut] > best:
                best, found = gain[cut], (f, cut)
                stats[2 * node + 1] = (float(left[cut]), float(n_left[cut]))
                stats[2 * node + 2] = (float(whole - left[cut]), float(n - n_left[cut]))
        if found:
            chosen[node] = found
    return chosen


def grow(grown: Grown, sizes: list[int]) -> Generator[Question, tuple, tuple[list, float | None]]:
    """Grows a model by questions: its trees as (splits, steps by node), and its error on the part it is measured on."""
    spec, n_columns, history = grown.spec, len(sizes), []
    rng = np.random.default_rng(spec.seed)
    (rows, total), _, _ = yield Question("total", {})
    if not rows:
        return history, None
    grown.start = total / rows if spec.quantile is None else (yield from quantiles({}, (), [0], [rows], spec.quantile))[0]
    n_skip, n_picked = round((1 - spec.subsample) * BUCKETS), max(1, round(spec.columns * n_columns))
    for _ in range(spec.rounds):
        skip = tuple(sorted(rng.choice(BUCKETS, n_skip, replace=False).tolist()))
        picked = sorted(rng.choice(n_columns, n_picked, replace=False).tolist())
        splits: dict = {}
        stats: dict = {}
        frontier = [0]
        for _ in range(spec.depth):
            hist, _, _ = yield Question("level", splits, skip, tuple(frontier), tuple(picked))
            fresh = splits_of(hist, frontier, picked, sizes, spec.least, stats)
            splits = splits | fresh
            frontier = [c for k in fresh for c in (2 * k + 1, 2 * k + 2)]
            if not frontier:
                break
        inner = set(splits)
        leaves = sorted({c for k in splits for c in (2 * k + 1, 2 * k + 2)} - inner) or [0]
        steps = np.zeros(1 << (spec.depth + 1))
        filled = [k for k in leaves if stats[k][1] > 0]
        if spec.quantile is None:
            values = [stats[k][0] / stats[k][1] for k in filled]
        else:
            values = (yield from quantiles(splits, skip, filled, [stats[k][1] for k in filled], spec.quantile)) if filled else []
        steps[filled] = spec.rate * np.array(values)
        grown.trees.append((splits, steps))
        history.append((splits, steps))
    rmse = None
    if spec.check is not None:
        (rows, squares), _, _ = yield Question("error", {})
        rmse = math.sqrt(max(squares, 0.0) / rows) if rows else math.nan
    return history, rmse


def in_order(history: list, edges: list[np.ndarray], start: float) -> trees.Ensemble:
    """The trees as arrays, with thresholds in place of bins."""
    grown = []
    for splits, steps in history:
        nodes: list = []

        def lay(k: int) -> int:
            me = len(nodes)  # noqa: B023
            nodes.append((0, 0.0, -1, -1, float(steps[k])))  # noqa: B023
            if k in splits:  # noqa: B023
                f, cut = splits[k]  # noqa: B023
                nodes[me] = (f, float(edges[f][cut]), lay(2 * k + 1), lay(2 * k + 2), 0.0)  # noqa: B023
            return me

        lay(0)
        grown.append(nodes)
    return trees.ensemble(grown or [[(0, 0.0, -1, -1, 0.0)]], [1.0] * max(1, len(grown)), start)


PACKED = "block int, keys binary, n binary, s binary, ss binary, held binary"


def packed(table: DataFrame, blocks: int) -> DataFrame:
    """Cells as one record per block, the blocks of about equal size."""

    def pack(rows: pa.Table) -> pa.Table:
        column = lambda c: pa.array([rows[c].to_numpy().tobytes()], pa.binary())
        keys = pa.array([b"".join(rows["key"].to_pylist())], pa.binary())
        none = pa.array([None], pa.binary())
        return pa.table([rows["block"].slice(0, 1), keys, column("n"), column("s"), column("ss"), none], names=["block", "keys", "n", "s", "ss", "held"])

    # in order of the key within a block, so that a fit does not depend on how rows arrived
    dealt = table.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(lambda rows: pack(rows.sort_by("key")), PACKED)


def _block(batch: pa.RecordBatch, row: int, n_columns: int, models: list[Grown] = ()) -> Block:
    get = lambda c: batch.column(c)[row].as_py()
    return Block(get("keys"), get("n"), get("s"), get("ss"), n_columns, get("held"), [m.base for m in models])


def _in_one_task(table: DataFrame, specs: list[Spec], sizes: list[int]) -> list[tuple[list, float, float | None]]:
    """Every model grown in a task of its own that has all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("spec")[row].as_py()
                block, grown = _block(batch, row, len(sizes)), Grown(specs[number], 0.0, [])
                asking = grow(grown, sizes)
                try:
                    ask = next(asking)
                    while True:
                        ask = asking.send(answer(block, number, grown, ask))
                except StopIteration as done:
                    history, rmse = done.value
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((history, grown.start, rmse))], pa.binary())], ["spec", "grown"])

    each = table.withColumn("spec", F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1)))).repartitionByRange(len(specs), "spec")
    found = {r.spec: pickle.loads(r.grown) for r in each.mapInArrow(run, "spec int, grown binary").collect()}  # bounded by rounds and depth
    return [found[k] for k in range(len(specs))]


def _over_blocks(table: DataFrame, specs: list[Spec], sizes: list[int]) -> list[tuple[list, float, float | None]]:
    """All models grown in step, every question of theirs one job over the blocks."""
    grown = [Grown(spec, 0.0, []) for spec in specs]
    asking = [grow(g, sizes) for g in grown]
    open_ = {k: next(a) for k, a in enumerate(asking)}
    found: dict = {}

    def ask_all(questions: dict[int, Question]) -> dict[int, tuple]:
        state = pickle.dumps((grown, questions))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, asked = pickle.loads(state)
            total: dict = {}
            for batch in batches:
                for row in range(batch.num_rows):
                    block = _block(batch, row, len(sizes), models)
                    for k, ask in asked.items():
                        got = answer(block, k, models[k], ask)
                        total[k] = added(total[k], got) if k in total else got
            yield _answers(total)

        def merge(rows: pa.Table) -> pa.Table:
            total: dict = {}
            for k, body in zip(rows["spec"].to_pylist(), rows["body"].to_pylist()):
                got = pickle.loads(body)
                total[k] = added(total[k], got) if k in total else got
            return pa.Table.from_batches([_answers(total)])

        parts = table.mapInArrow(run, "spec int, body binary")
        summed = parts.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("spec", "some").applyInArrow(merge, "spec int, body binary")
        return {r.spec: pickle.loads(r.body) for r in summed.groupBy("spec").applyInArrow(merge, "spec int, body binary").collect()}

    while open_:
        if max(len(g.trees) for g in grown) >= REWRITE:
            table = cut_lineage(_with_predictions(table, grown, len(sizes)), "blocks")
            for g in grown:
                g.base, g.trees = g.base + len(g.trees), []
        got = ask_all(open_)
        following = {}
        for k in open_:
            try:
                following[k] = asking[k].send(got[k])
            except StopIteration as done:
                found[k] = (done.value[0], grown[k].start, done.value[1])
        open_ = following
    return [found[k] for k in range(len(specs))]


def _answers(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pickle.dumps(x) for x in total.values()], pa.binary())], ["spec", "body"])


def _with_predictions(table: DataFrame, grown: list[Grown], n_columns: int) -> DataFrame:
    """The blocks with what all trees so far predict for their cells."""
    state = pickle.dumps(grown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = pickle.loads(state)
        for batch in batches:
            held = []
            for row in range(batch.num_rows):
                block = _block(batch, row, n_columns, models)
                held.append(np.stack([block.predicted(k, g) for k, g in enumerate(models)]).tobytes())
            columns = [pa.array(held, pa.binary()) if c == "held" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return table.mapInArrow(run, PACKED)


class Data:
    """A table reduced to blocks of cells, from which any number of models can be fitted."""

    def __init__(self, df: DataFrame, columns: list[str], label: str, keys: list[str], by_label: bool, part: Column | None = None):
        used = [F.col(f"`{c}`").cast("double").alias(c) for c in [*columns, label]]
        rows = df.select(*[c for c in keys if c not in (*columns, label)], *used, (F.lit(0) if part is None else part).alias("_wl_part")).dropna(subset=[*columns, label])
        self.edges = bin_edges(rows, columns)
        label_edges = bin_edges(rows, [label], LABEL_BINS)[0] if by_label else None
        self.sizes = [len(e) for e in self.edges]
        table = cut_lineage(cells(rows, columns, label, keys, F.col("_wl_part"), self.edges, label_edges), "cells")
        total = table.count()
        self.blocks = max(1, math.ceil(total / BLOCK_CELLS))
        self.table = cut_lineage(packed(table, self.blocks), "blocks") if total else None

    def fit(self, specs: list[Spec]) -> list[Fitted]:
        """Models of ``specs``; without rows a model predicts 0."""
        if self.table is None:
            return [Fitted(in_order([], self.edges, 0.0), None) for _ in specs]
        grown = (_in_one_task if self.blocks == 1 else _over_blocks)(self.table, specs, self.sizes)
        return [Fitted(in_order(history, self.edges, start), rmse) for history, start, rmse in grown]


def fit(df: DataFrame, columns: list[str], label: str, keys: list[str], specs: list[Spec], part: Column | None = None) -> list[Fitted]:
    """Boosted models of ``label`` on ``columns``, one for each of ``specs``, fitted on all rows of ``df``.

    Each round leaves out 1 - ``subsample`` of the buckets that rows are dealt into by ``keys``, and takes
    ``columns`` of the features. A leaf adds ``rate`` times the mean residual of its rows, or their
    quantile. Rows with a null in a feature or the label are left out. ``part`` (0 to 255) tells apart the
    rows that specs learn from and are measured on.
    """
    return Data(df, columns, label, keys, any(s.quantile is not None for s in specs), part).fit(specs)
