"""Learned operators: held-out accuracy, no leak from held-out labels, defined results for odd rows; the pipeline as a whole."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward
from tests.llm.test_joins import brute_components, brute_hits, key
from wattloom.llm import decontamination, langid, pii, quality, toxicity
from wattloom.llm.common import components, fold
from wattloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_on_held_out(spark, tables):
    rows = QUERIES["op9_toxicity"](spark, FOLDER).join(tables["labels"], "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert auc(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.85
    assert rows[rows.toxic == 0].predicted.mean() < 0.05


def test_toxicity_knows_rare_words(spark):
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(f"w{i}" for i in rng.zipf(1.3, 12) % 3000)
    # 600 words, the first in 30 texts, the last in 15; the 500th is the only toxic word of its texts
    bad = [f"{plain()} bad{i}" for i in range(600) for _ in range(30 - i // 40)]
    texts = bad + [plain() for _ in range(60_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where("toxic = 1 OR doc_id % 20 < 8"), max_labels=60_000)
    assert len(model.hashes) >= 590
    score = toxicity.score_texts(pa.array(["w1 w2 bad0 w3", "w1 w2 bad499 w3", "w1 w2 w3", ""]), model)
    assert score[0] >= 0.7 and score[1] >= 0.7 and score[2] < 0.5 and score[3] < 0.5


def test_quality_on_held_out(spark, tables):
    rows = QUERIES["op3_quality"](spark, FOLDER).join(tables["labels"], "doc_id").where("held_out AND quality IS NOT NULL").toPandas()
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.9


def test_language_on_held_out(spark, tables):
    rows = QUERIES["op7_language"](spark, FOLDER).join(tables["documents"].select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables["documents"].where("doc_id < 200"), tables["labels"]
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.weights, b.weights)


def test_odd_rows_and_empty_tables(spark, tables):
    docs, none = awkward(spark), tables["labels"].limit(0)
    small = tables["documents"].limit(0)
    model = toxicity.fit(docs, none)
    assert toxicity.score(docs, model).count() == 10 and toxicity.reject(docs, model).columns == docs.columns
    scored = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    named = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert named[1].lang_pred == named[2].lang_pred == named[7].lang_pred == "und" and named[4].lang_pred in ("en", "de")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(small)).collect()} == {"und"}
    for model, op in ((toxicity.fit(small, none), toxicity.score), (quality.fit(small, none), quality.score)):
        assert op(small, model).count() == 0


def test_pooling_reads_all_of_a_long_text():
    texts = pa.array(["a " * 400_000 + "zz", None])
    vectors = np.random.default_rng(0).normal(size=(quality.SLOTS, 4)).astype(np.float32)
    got = quality.pooled(texts, vectors)
    h = [(h % np.uint64(quality.SLOTS)) for _, _, _, w in quality.words.runs(texts, quality.words.SPACED, lower=False) for h in w.hash[-1:]]
    slot_a = [s for i, j, s, f in quality._slots(pa.array(["a"]))][0][0]
    want = (vectors[slot_a] * 400_000 + vectors[int(h[0])]) / 400_001
    assert np.allclose(got[0, :4], want, atol=1e-4) and not got[1].any()


def test_network_windows_cover_the_whole_text():
    codes = np.arange(700) % 50
    grid, text, held = langid._windows(codes, np.array([0, 600, 600, 700]))
    assert text.tolist() == [0, 0, 0, 2] and held.tolist() == [256, 256, 88, 100]
    assert np.concatenate([g[:n] for g, n in zip(grid, held)]).tolist() == codes.tolist()


def test_fast_filters_equal_the_plain_sum():
    q = langid._start(3, 1)
    grid = np.random.default_rng(0).integers(0, langid.CLASSES, (5, langid.WINDOW))
    got = langid._pool(grid, langid._pair_tables(q))
    plain = []
    for w in langid.WIDTHS:
        size = langid.WINDOW - w + 1
        plain.append((q[f"b{w}"] + sum(q[f"f{w}_{k}"][grid[:, k : k + size]] for k in range(w))).max(1))
    assert np.allclose(got, np.maximum(np.hstack(plain), 0), atol=1e-4)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 140)}


def test_pipeline_equals_brute_force(spark, tables):
    import corpus_pipeline

    docs = tables["documents"].where("doc_id < 260").unionByName(tables["documents"].where("doc_id < 5"))
    items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard", "decontamination", "pii", "packing"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    score = toxicity.score_texts(pa.array([r.text for r in docs.collect()]), toxicity.fit(docs, tables["labels"]))
    assert kept.columns == docs.columns and kept.count() == int((score < 0.7).sum())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = stages["jaccard"](spark, docs, FOLDER)
    want = {d for d, n, c, _ in brute_components(rows) if n == 0 or d == c}
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(want)
    clean = stages["decontamination"](spark, docs, FOLDER)
    hits = [(d, *brute_hits(t, items)[:2]) for d, t in rows]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, n, h in hits if not (h and 20 * h >= n))
    masked = stages["pii"](spark, docs, FOLDER)
    assert key((r.doc_id, r.text) for r in masked.collect()) == key((d, t and pii.mask(t, pii.find([t])[0][1])) for d, t in rows)
    assert stages["packing"](spark, docs, FOLDER).where("piece = 0").count() == len(rows)
    odd = awkward(spark)
    for name in ("toxicity", "jaccard", "decontamination", "pii"):
        assert set(stages[name](spark, odd, FOLDER).columns) == set(odd.columns)
        assert stages[name](spark, odd.limit(0), FOLDER).count() == 0
    assert sorted(r.doc_id or 0 for r in stages["jaccard"](spark, odd, FOLDER).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_a_rare_language_is_learned(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    common = {lang: [f"{a}{b}" for a in first for b in second] for lang, first, second in (("xx", ["ba", "lo", "mi"], ["ren", "tok", "sul"]), ("yy", ["qua", "zi", "vex"], ["phi", "nor", "ghu"]))}
    rows = [(k, make(common["xx" if k % 2 else "yy"], 30), "xx" if k % 2 else "yy") for k in range(6000)]
    rows += [(10_000 + k, make(["жда", "ёлк", "щук", "быт"], 30), "zz") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_texts=300)
    assert model.languages == ["xx", "yy", "zz"]
    got = langid.predict(docs.where("doc_id >= 10000"), model).where(F.col("lang_pred") == "zz").count()
    assert got == 12


def test_bytes_of_other_scripts_keep_their_own_class():
    assert len(set(langid.BYTE_CLASS[128:].tolist())) == 128 and langid.BYTE_CLASS.max() < langid.CLASSES
