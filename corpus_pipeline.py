"""A training corpus from raw documents: toxic texts out, one of each group of near copies, benchmark
passages out, personal data masked, packed into token sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import decontamination, jaccard, packing, pii, toxicity
from wattloom.llm.common import apply_decisions, cut_lineage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; rows without text or id stay."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of smallest id; of repeated rows one.

    Texts without words, and rows without id, are in no group and stay.
    """
    return apply_decisions(docs, cut_lineage(jaccard.surplus(jaccard.join(docs)), "copies"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: hit words make less than a twentieth. Rows without id stay."""
    found = decontamination.hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    n_hit = decontamination.covered(F.col("spans"))
    bad = found.where(decontamination.contaminated(n_hit, F.col("n_words"))).select("doc_id", "key", F.lit(0).alias("keep"))
    return apply_decisions(docs, cut_lineage(bad.distinct(), "contaminated"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores and token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
