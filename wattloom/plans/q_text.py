"""Documents, retrieval and conversations on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions import text_rules
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import rows, text
from wattloom.plans.registry import query
from wattloom.plans.views import Tables
from wattloom.session import cut_lineage, scratch


@query("parse_frontmatter", "SELECT doc_id, title, source, body FROM v_body", ("v_body",))
def _(t: Tables) -> DataFrame:
    return text.parse_frontmatter(t("v_kb_document"))


def passages(t: Tables) -> DataFrame:
    return text.chunk_documents(text.parse_frontmatter(t("v_kb_document")))


@query("chunk_documents", "SELECT * FROM v_chunk", ("v_chunk",))
def _(t: Tables) -> DataFrame:
    return passages(t)


@query("embed_chunks", "SELECT id, doc_id, CAST(256 AS BIGINT) AS dimensions, true AS unit_norm FROM v_chunk", ("v_chunk",))
def _(t: Tables) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return text.embed_chunks(passages(t)).select("id", "doc_id", F.size("embedding").alias("dimensions"), (F.abs(norm - 1) < 1e-4).alias("unit_norm"))


@query("rebuild_index", "SELECT count(*) AS passages, count(DISTINCT id) AS distinct_ids FROM v_chunk", ("v_chunk",))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "index")
    chunks = cut_lineage(passages(t), "chunks")  # the documents are cut once for both
    text.rebuild_index(chunks, path)
    index = text.rebuild_index(chunks, path)
    return index.agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("id").alias("distinct_ids"))


COSINE = (
    "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))"
)
VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
TOP_SQL = f"""
SELECT query_id, id, label, id_label, rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, q.label, c.vec_id AS id, c.label AS id_label, round({COSINE}, 9) AS cosine FROM {VECTORS} q, {VECTORS} c WHERE c.vec_id <> q.vec_id) a) b WHERE rank <= 3"""


def top(t: Tables) -> DataFrame:
    """Every vector asks all the others: one neighbour more, and without itself."""
    vectors = t.base("embeddings")
    corpus = vectors.select(F.col("vec_id").alias("id"), "embedding")
    found = text.vector_topk(corpus, vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 4)
    others = found.filter(F.col("id") != F.col("query_id"))
    return rows.newest(others, ["query_id"], [F.col("cosine").desc(), F.col("id")], 3)


@query("vector_topk", f"SELECT query_id, id, {r('greatest(0.0, cosine)', 4)} AS score FROM ({TOP_SQL}) x")
def _(t: Tables) -> DataFrame:
    return top(t).select("query_id", "id", "score")


@query("retrieval_quality", f"""
SELECT query_id, CAST(count(*) FILTER (WHERE label = id_label) > 0 AS BIGINT) AS hit_at_3, {r("coalesce(1.0 / min(CASE WHEN label = id_label THEN rank END), 0.0)", 4)} AS reciprocal_rank FROM ({TOP_SQL}) x GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    labels = t.base("embeddings").select(F.col("vec_id").alias("id"), "label")
    best_first = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    found = (
        top(t).withColumn("rank", F.row_number().over(best_first))
        .join(labels.withColumnsRenamed({"id": "query_id"}), "query_id")
        .join(labels.withColumnsRenamed({"label": "id_label"}), "id")
    )
    return text.retrieval_quality(found, F.col("label") == F.col("id_label"))


QUESTION = "'Nếu tăng setpoint ' || CAST(event_id % 3 AS STRING) || ',5 độ và tắt chiller sớm ' || CAST(event_id % 4 AS STRING) || ' giờ thì sao'"


@query("extract_scenario_args", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE TRY_CAST(replace(regexp_extract(m, '{S.SETPOINT_PATTERN}', 1), ',', '.') AS DOUBLE) END AS setpoint_delta_c,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE TRY_CAST(regexp_extract(m, '{S.EARLY_OFF_PATTERN}', 1) AS BIGINT) END AS off_hours
FROM (SELECT event_id, lower(CASE WHEN event_id % 5 = 0 THEN replace({QUESTION}, 'Nếu', 'Xin') ELSE {QUESTION} END) AS m FROM events) q""")
def _(t: Tables) -> DataFrame:
    asked = F.expr(f"CASE WHEN event_id % 5 = 0 THEN replace({QUESTION}, 'Nếu', 'Xin') ELSE {QUESTION} END")
    args = text_rules.scenario_args(F.col("question"))
    return t.base("events").select("event_id", asked.alias("question")).select("event_id", *[c.alias(n) for n, c in args.items()])
