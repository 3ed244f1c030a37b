"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import decontamination, html, jaccard, langid, licences, negatives, neighbours, packing, pii, quality, repair, tokencounts, toxicity
from wattloom.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql.strip()
        return build

    return register


def held_out(mod: int, rest: int):
    """Whether a document is of the held-out fold; a null id is of none."""
    return F.coalesce(fold(F.col("doc_id"), mod) == rest, F.lit(False))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(quality.HELD_OUT_MOD, quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    named = langid.predict(docs, langid.fit(docs))
    return named.select("doc_id", held_out(langid.HELD_OUT_MOD, langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(toxicity.HELD_OUT_MOD, toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Words as operators 1 and 10 read them, in DuckDB.
ALNUM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op10_decontamination",
    f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM_SQL} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_SQL} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    counted = found.withColumn("n_hit", decontamination.covered(F.col("spans"))).withColumn("n_items", F.size("items").cast("long"))
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op1_licences")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@query("op2_main_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"))


@query("op8_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op6_jaccard",
    r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n AS a ON a.rid = x JOIN n AS b ON b.rid = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, (SELECT count(*) FROM l WHERE l.x = w.rid) AS n_links
FROM w LEFT JOIN n USING (rid) JOIN m ON m.x = w.rid
""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents")).drop("key")


@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.count(table(spark, folder, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after the faults that the crc32 of `conv_id:turn` plants: 0 drops, 1 empties, 2 takes the
    sentence ends away, 3 repeats, 4 sets role user. Nulls are one blank there, and as role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))")).alias("copy")).drop("copy")


#: crc32 of an ASCII text x: bytes into the register one after the other, eight shifts each.
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(x, ''), lambda c: ascii(c)::BIGINT)),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN (v & 1) = 1 THEN 3988292384 ELSE 0 END))))"""


@query(
    "op12_conversation_repair",
    rf"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL} % 20 AS kind
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations)
),
d AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM k, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
),
o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini
    FROM d
),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault FROM o),
n AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated
    FROM f GROUP BY conv_id
),
g AS (
    SELECT conv_id, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT conv_id, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id
),
put(q, ins, added, p) AS (  -- insertions before a row, from state q to p: 0 nothing yet, 1 system, 2 user, 3 assistant
    VALUES (0, '', [], 0), (1, '', [], 1), (2, '', [], 2), (3, '', [], 3), (0, 'I', ['user:'], 2), (1, 'I', ['user:'], 2), (3, 'I', ['user:'], 2),
           (2, 'I', ['assistant:'], 3), (0, 'II', ['user:', 'assistant:'], 3), (1, 'II', ['user:', 'assistant:'], 3)
),
step(p, edit, ini, role, q) AS (  -- an edit of a row whose initial is ini (null: any), the role it gets (null: its own)
    VALUES (0, 'D', NULL, NULL, 0), (1, 'D', NULL, NULL, 1), (2, 'D', NULL, NULL, 2), (3, 'D', NULL, NULL, 3), (0, 'K', 's', NULL, 1), (0, 'K', 'u', NULL, 2),
           (1, 'K', 'u', NULL, 2), (3, 'K', 'u', NULL, 2), (2, 'K', 'a', NULL, 3), (0, 'R', NULL, 'user', 2), (1, 'R', NULL, 'user', 2), (3, 'R', NULL, 'user', 2),
           (2, 'R', NULL, 'assistant', 3)
),
w AS (
    SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM f
    UNION ALL
    SELECT conv, i, q, cost, audit, said FROM (
        SELECT w.conv, f.i, step.q, w.cost + 3 * len(put.ins) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 3 ELSE 0 END AS cost,
               w.audit || put.ins || edit AS audit,
               list_concat(w.said, put.added, CASE WHEN edit = 'D' THEN [] ELSE [coalesce(step.role, f.role) || ':' || text] END) AS said
        FROM w JOIN f ON w.conv = coalesce(CAST(f.conv_id AS VARCHAR), ' ') AND f.i = w.i + 1 JOIN put ON put.q = w.q JOIN step ON step.p = put.p
        WHERE (step.ini IS NULL OR step.ini = f.ini) AND (edit = 'D' OR fault IN ('k', 't'))
    )
    QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, audit) = 1
),
e AS (
    SELECT conv, cost + 3 * len(put.ins) AS cost, audit || put.ins AS audit, list_concat(said, put.added) AS said
    FROM w JOIN n ON w.conv = coalesce(CAST(n.conv_id AS VARCHAR), ' ') AND w.i = n.n JOIN put ON put.q = w.q WHERE put.p IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost + 3 * len(put.ins), audit || put.ins) = 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv = coalesce(CAST(c.conv_id AS VARCHAR), ' ')
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return repaired_conversations(rows)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The report of every conversation of ``rows`` after :func:`damaged`; one that lost all its rows has zeros."""
    found = repair.report(damaged(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


@query(
    "op13_hard_negatives",
    """
WITH e AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.rid AS aid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM e AS a JOIN e AS b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
c AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.aid, p.place ORDER BY n.score DESC, n.vec_id) AS rank
    FROM p JOIN s AS n ON n.aid = p.aid AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 10
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


def hard_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, after every seventh id got the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
