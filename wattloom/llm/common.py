"""What the corpus operators share: row-wise Arrow jobs, folds, bounded labelled samples, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.session import cut_lineage, scratch  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: Column, mod: int) -> Column:
    """crc32 of a value's text, modulo ``mod``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % mod


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def record(columns: dict, schema: str) -> pa.RecordBatch:
    """A record batch of equally long columns under a flat schema such as `doc_id long, score double`."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([_column(columns[name], ARROW[kind]) for name, kind in fields], [name for name, _ in fields])


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """``work`` on each Arrow batch; it returns a dict of equally long columns, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (got := work(batch)) is not None:
                yield record(got, schema)

    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], dict]) -> DataFrame:
    """``work`` on the rows of each key as one Arrow table; callers bound the size of a key's rows."""
    return df.groupBy(*keys).applyInArrow(lambda rows: pa.Table.from_batches([record(work(rows), schema)]), schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def labelled_sample(labels: DataFrame, column: str, keep: Column, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled rows (doc_id, y), one per document, chosen by a hash of the id.

    Rows with a null id or label are no labels; of contradicting labels the larger counts.
    ``keep`` names the ids that may be learned from. The bound makes the result fit for a broadcast.
    """
    rows = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


#: Slots of the id filter; it stays this small for any number of ids, and then lets more rows pass.
ID_SLOTS = 1 << 24


def marked(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` with a boolean `_wl_may`: false only where ``column`` is surely not in the one column of ``ids``.

    The ids become bits of a table of at most ``ID_SLOTS / 64`` rows, which is what gets broadcast, so
    that large rows need no shuffle to learn that they don't take part.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS))
    ids = ids.select(slot(F.col(ids.columns[0])).alias("_wl_s"))
    bits = ids.groupBy(F.expr("shiftright(_wl_s, 6)").alias("_wl_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_wl_s % 64 AS int)))").alias("_wl_bits"))
    out = df.withColumn("_wl_slot", slot(F.col(column)))
    out = out.join(F.broadcast(bits), F.expr("shiftright(_wl_slot, 6) = _wl_word"), "left")
    hit = F.expr(f"`{column}` IS NOT NULL AND coalesce(shiftright(_wl_bits, cast(_wl_slot % 64 AS int)) & 1 = 1, false)")
    return out.withColumn("_wl_may", hit).drop("_wl_slot", "_wl_word", "_wl_bits")


def apply_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` after ``decisions`` (doc_id, key, keep): of the rows of that id whose text hashes to key, none or one stays.

    Rows without a decision stay as they are. Only rows whose id may have one are shuffled.
    """
    names = docs.columns
    may = marked(docs, "doc_id", decisions.select("doc_id"))
    said = decisions.select(F.col("doc_id").alias("_wl_id"), F.col("key").alias("_wl_key"), F.col("keep").alias("_wl_keep"))
    asked = may.where("_wl_may").withColumn("_wl_text", F.xxhash64("text"))
    asked = asked.join(said, F.expr("doc_id = _wl_id AND _wl_text = _wl_key"), "left")
    free = asked.where("_wl_keep IS NULL").select(names)
    one = F.row_number().over(Window.partitionBy("_wl_id", "_wl_key").orderBy("_wl_text"))
    kept = asked.where("_wl_keep = 1").withColumn("_wl_rank", one).where("_wl_rank = 1").select(names)
    return may.where("NOT _wl_may").select(names).union(free).union(kept)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of the connected components of edges (a, b); the root is a component's smallest node.

    Large-star and small-star steps in turn, each an aggregation and a join on the node, until nothing
    changes; every round is written, so lost executors cost one round at most.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut_lineage(now, label), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        before = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        near = large.join(low, large["a"] == low["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = near.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        now = cut_lineage(small, label)


def collect_rows(df: DataFrame) -> pa.Table:
    """A result bounded by parameters, brought to the driver."""
    return df.toArrow()


def adam(grads: Callable[[dict, int], dict], params: dict, steps: int, rate: float, decay: float = 0.0) -> dict:
    """Plain Adam over a dict of arrays; ``grads(params, step)`` returns the gradients."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    for t in range(1, steps + 1):
        for k, g in grads(params, t).items():
            g = g + decay * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return params


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
