"""Skew-proof building blocks against brute force on small fixtures."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.operators import forest, incidents, rows, text
from wattloom.operators.text import split_passages

START = dt.datetime(2024, 1, 1)


def readings(spark, n=3000, seed=1):
    """A third of all rows belong to one meter."""
    rng = random.Random(seed)
    data = [
        (i, "hot" if i % 3 == 0 else f"m{rng.randrange(40)}", START + dt.timedelta(seconds=rng.randrange(10 * 86400)), float(rng.randrange(1, 100)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id long, meter_id string, timestamp timestamp_ntz, v double")


def test_history_copies_equal_a_whole_window(spark):
    df = readings(spark)
    whole = Window.partitionBy("meter_id").orderBy("timestamp", "id")
    want = df.withColumn("a", F.collect_list("id").over(whole.rowsBetween(-20, -1))).withColumn("l", F.lag("v", 20).over(whole))
    spread, keys = rows.with_history(df, ["meter_id"], "timestamp", "id", ["v"], 20)
    part = Window.partitionBy(*keys).orderBy("timestamp", "id")
    got = spread.withColumn("a", F.collect_list("id").over(part.rowsBetween(-20, -1))).withColumn("l", F.lag("v", 20).over(part))
    got = got.filter(~F.col("_copy"))
    key = lambda df: sorted((r.id, tuple(r.a), r.l) for r in df.select("id", "a", "l").collect())
    assert key(got) == key(want)


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(rows, "HOT_BUCKET_ROWS", 20)
    test_history_copies_equal_a_whole_window(spark)
    spread, keys = rows.with_history(readings(spark), ["meter_id"], "timestamp", "id", ["v"], 5)
    sizes = [r.c for r in spread.filter(~F.col("_copy")).groupBy(*keys).agg(F.count("*").alias("c")).collect()]
    assert max(sizes) < 60 and sum(sizes) == 3000


def test_newest_with_and_without_salt(spark):
    df = readings(spark)
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    rank = F.row_number().over(Window.partitionBy("meter_id").orderBy(*order))
    for n in (5, 1200):
        want = sorted(r.id for r in df.withColumn("r", rank).filter(F.col("r") <= n).collect())
        assert sorted(r.id for r in rows.newest(df, ["meter_id"], order, n).collect()) == want


def test_group_limit_runs_before_the_shuffle(spark):
    plan = rows.newest(readings(spark), ["meter_id"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_global_position(spark):
    df = readings(spark)
    got = rows.global_position(df, [F.col("v"), F.col("id")], "test", 7)
    assert [r.position for r in got.orderBy("v", "id").collect()] == list(range(1, 3001))


def brute_cooldown(events, stored=()):
    out, open_row = [], {}
    for o in sorted((o for o in stored if o["status"] == "OPEN"), key=lambda o: (o["timestamp"], o["id"])):
        open_row[o["meter_id"]] = {"id": o["id"], "timestamp": o["timestamp"], "actual": o["actual_reading"], "updates": 0}
    out += open_row.values()
    for e in sorted(events, key=lambda e: (e["timestamp"], e["id"])):
        o = open_row.get(e["meter_id"])
        if o and (e["timestamp"] - o["timestamp"]).total_seconds() <= 600:
            if e["actual_kwh"] > o["actual"]:
                o.update(timestamp=e["timestamp"], actual=e["actual_kwh"], updates=o["updates"] + 1)
        else:
            open_row[e["meter_id"]] = {"id": f"ANOM-LIVE-{e['id']}", "timestamp": e["timestamp"], "actual": e["actual_kwh"], "updates": 0}
            out.append(open_row[e["meter_id"]])
    return sorted((o["id"], o["timestamp"], o["actual"], o["updates"]) for o in out if o["updates"] or o["id"].startswith("ANOM-LIVE"))


def random_events(seed, n, gaps, top):
    rng = random.Random(seed)
    events, at = [], START
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice(gaps))
        events.append(
            {"id": i, "building_id": "b", "meter_id": "hot" if i % 3 else f"m{i % 5}", "timestamp": at,
             "actual_kwh": float(rng.randrange(top)), "anomaly_score": 0.5, "severity": "MEDIUM"}
        )
    return events


EVENT = "id long, building_id string, meter_id string, timestamp timestamp_ntz, actual_kwh double, anomaly_score double, severity string"


STORED = "id string, building_id string, meter_id string, timestamp timestamp_ntz, opened_at timestamp_ntz, actual_reading double, anomaly_score double, severity string, status string"


def outcome(got):
    return sorted((r.id, r.timestamp, r.actual_reading, r.updates) for r in got.collect())


@pytest.mark.parametrize(
    "seed, gaps, top",
    [
        (3, [30, 200, 590, 600, 601, 4000], 100), (4, [0, 1, 20], 5), (5, [100, 300], 3), (6, [0, 600], 1000), (7, [5], 1),
        (8, [300, 86_000, 86_400, 200_000], 4), (9, [590, 43_190], 6),
    ],
)
def test_cooldown_over_blocks_equals_one_fold(spark, seed, gaps, top, monkeypatch):
    events = random_events(seed, 2000, gaps, top)
    df = spark.createDataFrame(pd.DataFrame(events), EVENT)
    assert outcome(incidents.incident_cooldown(df)) == brute_cooldown(events)
    rng = random.Random(seed)
    stored = [
        {"id": f"OLD-{m}-{k}", "building_id": "b", "meter_id": m, "timestamp": START + dt.timedelta(seconds=rng.choice([-4000, -300, 0, 500, 5000])), "opened_at": START - dt.timedelta(hours=2),
         "actual_reading": float(rng.randrange(top)), "anomaly_score": 0.1, "severity": "MEDIUM", "status": status}
        for m in ("hot", "m0", "m3", "none") for k, status in enumerate(("OPEN", "RESOLVED"))
    ]
    monkeypatch.setattr(incidents, "BLOCK_US", 3_600_000_000)  # shorter blocks, more hops
    got = incidents.incident_cooldown(df, spark.createDataFrame(pd.DataFrame(stored), STORED))
    assert outcome(got) == brute_cooldown(events, stored)


def test_a_flat_load_is_spread_over_its_days(spark):
    n = 60_000  # equal readings of one meter, one a minute
    df = spark.range(n).selectExpr("id", "'b' AS building_id", "'m' AS meter_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, CAST(id AS int)) AS timestamp", "5.0D AS actual_kwh", "0.5D AS anomaly_score", "'MEDIUM' AS severity")
    starts = spark.createDataFrame([("m", 0, 0)], "meter_id string, from_ts long, from_id long")
    sizes = [r["count"] for r in incidents.cooldown_blocks(df, starts).groupBy("day").count().collect()]
    assert len(sizes) == 42 and max(sizes) <= 1440 + 12
    got = incidents.incident_cooldown(df).collect()
    assert len(got) == -(-n // 11) and {r.updates for r in got} == {0}


def test_second_event_within_ten_minutes_is_no_new_incident(spark):
    schema = "id long, building_id string, meter_id string, timestamp timestamp_ntz, actual_kwh double, anomaly_score double, severity string"
    data = [
        (1, "b", "m", START, 45.2, 0.89, "CRITICAL"), (2, "b", "m", START + dt.timedelta(minutes=5), 40.0, 0.9, "CRITICAL"),
        (3, "b", None, START, 1.0, 0.6, "MEDIUM"), (4, "b", None, START, 1.0, 0.6, "MEDIUM"),
    ]
    got = incidents.incident_cooldown(spark.createDataFrame(data, schema)).collect()
    assert sorted(r.id for r in got) == ["ANOM-LIVE-1", "ANOM-LIVE-3", "ANOM-LIVE-4"]


def test_vector_topk_over_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(text, "QUERY_BLOCK", 7)
    monkeypatch.setattr(text, "CORPUS_SLICE", 50)
    rng = np.random.default_rng(5)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    corpus[10] = corpus[200]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    cosine = np.round((queries @ corpus.T) / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(corpus, axis=1), 9)
    want = {(i, int(j)) for i in range(20) for j in np.lexsort((np.arange(300), -cosine[i]))[:4]}
    assert {(r.query_id, r.id) for r in text.vector_topk(c, q, 4).collect()} == want
    assert text.vector_topk(c, q, 1000).count() == 20 * 300


def test_vector_topk_shuffles_no_copies_and_settles_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(text, "QUERY_BLOCK", 7)
    monkeypatch.setattr(text, "CORPUS_SLICE", 50)
    rng = np.random.default_rng(6)
    corpus = rng.normal(size=(300, 8))
    corpus[40:260] = corpus[40]  # more equal vectors than a pack holds
    corpus[3] = 0
    queries = np.vstack([rng.normal(size=(30, 8)), corpus[40:41], np.zeros((1, 8))])
    c = spark.createDataFrame([(None if i == 299 else i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    found = text.vector_topk(c, q, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "CoGroups" not in plan
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(corpus, axis=1)
    cosine = np.round(np.divide(queries @ corpus.T, norms, out=np.zeros(norms.shape), where=norms > 0), 9)
    ids = np.append(np.arange(299), -1)  # null comes first
    want = {(i, int(ids[j]), cosine[i, j]) for i in range(32) for j in np.lexsort((ids, -cosine[i]))[:5]}
    assert {(r.query_id, -1 if r.id is None else r.id, r.cosine) for r in found.collect()} == want


def test_passages_cover_the_text():
    rng = random.Random(2)
    body = "".join(rng.choice(["word ", "end. ", "line\n", "para\n\n", "x" * 30]) for _ in range(4000))
    parts = split_passages(body)
    assert all(len(p) <= 1200 for p in parts) and split_passages("short") == ["short"]
    place = 0
    for p in parts:
        found = body.find(p, max(0, place - 250))
        assert 0 <= found <= place + 5
        place = found + len(p)
    assert place >= len(body.rstrip()) - 1


def test_chunks_leave_a_batch_in_parts(monkeypatch):
    monkeypatch.setattr(text, "SPLIT_BYTES", 5000)

    class Documents:
        select = lambda self, *names: self
        mapInArrow = lambda self, work, schema: work  # noqa: E731, N815

    bodies = ["word " * n for n in (0, 10, 900, 4000, 3, 300, 700, 5)] + [None]
    columns = {"doc_id": pa.array(range(9)), "title": pa.array(["t"] * 9), "source": pa.array(["s"] * 9), "body": pa.array(bodies)}
    got = list(text.chunk_documents(Documents())(iter([pa.RecordBatch.from_pydict(columns)])))
    assert len(got) >= 4
    want = [(f"{d}_chunk_{i}", d, i, len(p), x) for d, b in enumerate(bodies) for p in [split_passages(b or "")] for i, x in enumerate(p)]
    assert [tuple(r[c] for c in ("id", "doc_id", "chunk_index", "total_chunks", "text")) for b in got for r in b.to_pylist()] == want


def test_passages_are_tokenised_once(spark):
    chunks = spark.createDataFrame([("a", "peak tariff"), ("b", "chiller, chiller"), ("c", "")], "id string, text string")
    found = text.embed_chunks(chunks)
    assert "_words" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.id, len(r.embedding)) for r in found.collect()) == [("a", 256), ("b", 256), ("c", 256)]


def spiked(spark):
    rng = np.random.default_rng(9)
    data = [("b", i, float(v), float(w)) for i, (v, w) in enumerate(rng.normal(size=(2000, 2)))]
    data += [("b", 5000 + i, 9.0 + i, -9.0) for i in range(10)]
    return spark.createDataFrame(data, "building_id string, n long, x double, y double")


def test_forest_finds_spikes_and_repeats(spark):
    df = spiked(spark)
    fit = lambda: forest.isolation_forest_fit(df, ["x", "y"], ["building_id", "n"], trees=60)
    model, again = fit(), fit()
    scored = forest.isolation_forest_score(df, model)
    found = {r.n for r in scored.filter(F.col("label") == -1).collect()}
    assert set(range(5000, 5010)) <= found and 0.02 <= len(found) / 2010 <= 0.04
    bounds = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert bounds[0] >= 0 and bounds[1] <= 1
    other = forest.isolation_forest_score(df, again)
    assert sorted(r.decision for r in scored.collect()) == sorted(r.decision for r in other.collect())


def test_forest_drawn_from_all_rows_keeps_the_spikes_in_scores(spark):
    df = spiked(spark)
    model = forest.isolation_forest_fit(df, ["x", "y"], ["building_id", "n"], trees=40, sample=128)
    top = forest.isolation_forest_score(df, model).orderBy(F.col("anomaly_score").desc()).limit(10)
    assert {r.n for r in top.collect()} == set(range(5000, 5010))


def test_questions_find_their_passage(spark, tmp_path):
    docs = [("tariff", "t", "s", "peak tariff price hours"), ("hvac", "t", "s", "chiller setpoint cooling"), ("other", "t", "s", "garden flowers")]
    chunks = text.chunk_documents(spark.createDataFrame([(i, *d[1:]) for i, d in enumerate(docs)], "doc_id long, title string, source string, body string"))
    index = text.rebuild_index(chunks, str(tmp_path / "index"))
    asked = index.filter(F.col("doc_id") == 1).select(F.lit("q").alias("query_id"), "embedding")
    found = text.query_knowledge(index, asked, 2).orderBy(F.col("score").desc()).collect()
    assert (found[0].id, found[0].score) == ("1_chunk_0", 1.0) and len(found) == 2
    norms = index.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-5 for r in norms)
