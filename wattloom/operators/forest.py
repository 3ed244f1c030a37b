"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Samples are drawn by row hashes, trees grow in parallel on 256 rows each,
and scoring walks the broadcast trees batch by batch. All chance comes from
md5 sums of keys and node numbers, so a fit is the same on every run and in
any engine; the fitted forest is a table of nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators import rows
from wattloom.operators.trees import Ensemble

EULER = 0.5772156649015329
NODE_SCHEMA = "tree INT, node INT, place LONG, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE"
#: Step by which each tree's draw is turned against the one before: the golden section.
TURN = 0.6180339887498949
BITS_52 = float(1 << 52)
SCORE_GRID = 1_000_000


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def position(keys: list[str]) -> Column:
    """A row's place in [0, 1), from the md5 of its keys."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / BITS_52


def turned(place: Column, tree: Column) -> Column:
    """A row's place for one tree: one hash per row serves all trees."""
    moved = place + tree * F.lit(TURN)
    return moved - F.floor(moved)


def chances(seed: int, tree: int, place: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a node."""
    digits = hashlib.md5(f"{seed}:{tree}:{place}".encode()).hexdigest()
    return int(digits[:13], 16) / BITS_52, int(digits[16:29], 16) / BITS_52


def grow(sample: np.ndarray, seed: int, tree: int) -> list[tuple[int, int, float, int, int, float]]:
    """One isolation tree; leaves hold their depth plus the path still expected there.

    Nodes carry their place: the root's is 1, the children of p are 2p and 2p + 1.
    """
    limit = math.ceil(math.log2(max(len(sample), 2)))
    nodes: list = []

    def split(x: np.ndarray, depth: int, place: int) -> int:
        me = len(nodes)
        nodes.append(None)
        low, high = x.min(axis=0), x.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(x) <= 1 or len(usable) == 0:
            nodes[me] = (place, 0, 0.0, -1, -1, depth + average_path(len(x)))
            return me
        which, where = chances(seed, tree, place)
        feature = int(usable[int(which * len(usable))])
        threshold = float(low[feature] + where * (high[feature] - low[feature]))
        if threshold >= high[feature]:  # neighbours in floating point
            threshold = float(low[feature])
        mask = x[:, feature] <= threshold
        nodes[me] = (place, feature, threshold, split(x[mask], depth + 1, 2 * place), split(x[~mask], depth + 1, 2 * place + 1), 0.0)
        return me

    split(sample, 0, 1)
    return nodes


@dataclass
class IsolationForest:
    columns: list[str]
    nodes: DataFrame
    sample: int
    offset: float = 0.0
    score_min: float = 0.0
    score_max: float = 0.0

    def ensemble(self) -> Ensemble:
        """The node table as arrays: at most trees x 511 rows, whatever it was fitted on."""
        table = self.nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        starts = table.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
        offset = table["tree"].map(starts).to_numpy()
        left, right = table["left"].to_numpy(), table["right"].to_numpy()
        return Ensemble(
            table["tree"].to_numpy(), table["feature"].to_numpy(), table["threshold"].to_numpy(),
            np.where(left >= 0, left + offset, -1), np.where(right >= 0, right + offset, -1),
            table["path"].to_numpy(), np.full(table["tree"].nunique(), 1.0),
        )


def _raw_score(df: DataFrame, model: IsolationForest) -> DataFrame:
    """Adds ``_score`` in (0, 1]: high is abnormal."""
    trees = df.sparkSession.sparkContext.broadcast(model.ensemble())
    norm = average_path(model.sample) or 1.0

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest = trees.value
        for part in parts:
            x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, len(model_columns)))
            yield pd.Series(np.power(2.0, -forest.predict(x) / len(forest.weights) / norm))

    model_columns = list(model.columns)
    return df.withColumn("_score", score(F.array(*[F.col(c).cast("double") for c in model_columns])))


def grid_quantile(df: DataFrame, column: str, share: float) -> tuple[float, float, float]:
    """Minimum, ``share`` quantile and maximum of a value in 0..1 on a grid of 1e-6.

    Counting grid values first makes the rest independent of the row count:
    at most a million rows reach the final window.
    """
    counts = df.groupBy(F.round(F.col(column) * SCORE_GRID).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(F.lit(0)).orderBy("g")
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(F.lit(0)))
    )
    place = (F.col("n") - 1) * F.lit(share)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("g")))
    row = placed.agg(
        F.min("g").alias("lo"), F.max("g").alias("hi"), at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"),
        F.max(place - F.floor(place)).alias("f"),
    ).first()
    return row.lo / SCORE_GRID, (row.a + (row.b - row.a) * row.f) / SCORE_GRID, row.hi / SCORE_GRID


def isolation_forest_fit(
    features: DataFrame, columns: list[str], keys: list[str],
    trees: int = 150, contamination: float = 0.03, sample: int = 256, seed: int = 42,
) -> IsolationForest:
    """Fits on any number of rows; each tree sees ``sample`` of them.

    Every tree draws straight from the whole table by row hashes, some twice as
    many as it keeps; only drawn rows are shuffled. The threshold is the
    contamination quantile over all training scores.
    """
    total = features.count()
    share = min(1.0, 2.0 * sample / max(total, 1))
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    drawn = (
        features.select(*keys, vector.alias("x"), position(keys).alias("_p"))
        .withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: turned(F.col("_p"), t) < share)))
        .withColumn("_u", turned(F.col("_p"), F.col("tree")))
    )
    chosen = rows.newest(drawn, ["tree"], [F.col("_u"), *[F.col(k) for k in keys]], sample)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        ordered = np.stack(pdf.sort_values("_u")["x"].to_numpy())
        nodes = grow(ordered, seed, number)
        out = pd.DataFrame(nodes, columns=["place", "feature", "threshold", "left", "right", "path"])
        return out.assign(tree=number, node=range(len(out)))[["tree", "node", "place", "feature", "threshold", "left", "right", "path"]]

    from wattloom.session import cut_lineage

    nodes = cut_lineage(chosen.groupBy("tree").applyInPandas(build, NODE_SCHEMA), "forest")
    model = IsolationForest(list(columns), nodes, min(sample, total))
    scored = _raw_score(features, model)
    low, threshold, high = grid_quantile(scored, "_score", 1.0 - contamination)
    model.offset, model.score_min, model.score_max = threshold, low - threshold, high - threshold
    return model


def isolation_forest_score(df: DataFrame, model: IsolationForest) -> DataFrame:
    """Adds ``decision`` (negative is abnormal), ``label`` (-1 or 1) and ``anomaly_score`` in 0..1."""
    decision = F.lit(model.offset) - F.col("_score")
    width = model.score_max - model.score_min
    scaled = (-decision - model.score_min) / width if width > 0 else F.lit(0.0)
    return (
        _raw_score(df, model)
        .withColumn("decision", decision)
        .withColumn("label", F.when(F.col("decision") < 0, -1).otherwise(1))
        .withColumn("anomaly_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
        .drop("_score")
    )
