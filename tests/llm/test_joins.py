"""Near copies, contamination, packing and neighbours against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SPACED, awkward, prose, words
from wattloom.llm import decontamination, jaccard, neighbours, packing


def shingles(text):
    w = words(text, SPACED)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """(component, links) of each row, rows without id left out."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if d is not None else None, degree[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(text, seed, edits):
    w, rng = text.split(), random.Random(seed)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
    return " ".join(w)


def near_copies(n_base=12, copies=8):
    out, at = [], 100
    for b in range(n_base):
        base = prose(b, random.Random(b).choice([4, 5, 6, 9, 15, 40, 120, 300]))
        for c in range(copies):
            out.append((at, edited(base, at, random.Random(at).choice([0, 0, 1, 1, 2, 3])), "en", "s", 1))
            at += 1
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_components_equal_brute_force(spark):
    docs = awkward(spark, near_copies())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.join(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert key(map(tuple, got)) == key(brute_components(rows))
    assert jaccard.join(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 1200)
    monkeypatch.setattr(jaccard, "GROUP_TILE", 30)
    base = prose(77, 60)
    more = [(200 + k, edited(base, k, 1 + k % 3), "en", "s", 1) for k in range(120)]
    docs = awkward(spark, more)
    got = jaccard.join(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert key(map(tuple, got)) == key(brute_components([(r.doc_id, r.text) for r in docs.collect()]))


def test_signatures_never_miss_a_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        s = int(rng.integers(1, 60))
        t = int(rng.integers(s, s * 5 // 4 + 1))
        most = (s + t) // 9
        if most < t - s:
            continue
        cut = (most - (t - s)) // 2
        a = rng.integers(0, 1 << 50, s, dtype=np.uint64)
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 50, t - s + cut, dtype=np.uint64)])
        sig, own = jaccard.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, s, s + t]))
        assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_compare_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    exact = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*(x.tolist() for x in jaccard.compare(sets)))) == exact


def test_forest_connects_what_the_sketches_leave_open():
    rng = np.random.default_rng(6)
    counters = rng.integers(0, 4, (50, 8)).astype(np.uint8)
    n = rng.integers(20, 60, 50)
    root = list(range(50))

    def joined(edges):
        root[:] = range(50)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in edges:
            root[find(i)] = find(j)
        return {frozenset(k for k in range(50) if find(k) == find(i)) for i in range(50)}

    every = [(i, j) for i in range(50) for j in range(i) if 9 * np.abs(counters[i].astype(int) - counters[j]).sum() <= n[i] + n[j]]
    assert joined(zip(*jaccard.near_forest(counters.astype(np.int16), n))) == joined(every)


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, other in items:
        o = words(other)
        n = min(13, len(o))
        windows = {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(500 + k, rng.choice([1, 3, 7, 12, 13, 14, 40]))) for k in range(30)] + [(90, None), (91, ""), (None, prose(500, 20)), (3, prose(503, 20))]
    more = []
    for k in range(60):
        part = prose(900 + k, 30).split()
        w = words(rng.choice(items)[1])
        if w:
            a = rng.randrange(len(w))
            part[10:10] = w[a : a + rng.randint(1, 30)]
        more.append((300 + k, " ".join(part).upper() if k % 3 else ", ".join(part), "en", "s", 1))
    docs = awkward(spark, more)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, fp int")
    found = decontamination.hits(docs, bench)
    got = found.select("doc_id", "n_words", decontamination.covered(found["spans"]).alias("n_hit"), "items").collect()
    assert key((d, n, h, tuple(i)) for d, n, h, i in got) == key((r.doc_id, *(lambda n, h, f: (n, h, tuple(f)))(*brute_hits(r.text, items))) for r in docs.collect())
    none = decontamination.hits(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("size(spans) > 0").count() == 0
    assert decontamination.hits(docs.limit(0), bench).count() == 0


def test_winnowing_keeps_the_least_hash_of_every_window():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 5, 60).astype(np.uint64)  # many ties
    first = np.array([0, 3, 30, 60])
    kept = set(decontamination.winnow(grams, first).tolist())
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        for s in range(a, b - decontamination.REACH):
            window = grams[s : s + decontamination.REACH + 1]
            want.add(max(s + k for k in range(len(window)) if window[k] == window.min()))
    assert kept == want


def test_tokens_equal_the_library():
    import pyarrow as pa

    from wattloom.llm.words import slices, utf8

    coder = packing.Tokeniser(packing.default_vocabulary())
    rng = random.Random(2)
    alphabet = [*"ab'srtvelmd'  \n\t19!?é 　漢字", "'s", "'ll", " 've", "\r\n", "<|endoftext|>", "͸", "😀", "'re"]
    texts = [None, "", "'s", "x's", "I'll've", "''s", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000))]
    data, offsets = utf8(pa.array(texts))
    got = []
    for i, j in slices(offsets):
        ids, first = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [e.ids + [packing.END_ID] for e in coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("texts", [["it's"], ["we'll"], ["", "they're"], ["a b", "don't"], ["it's", ""]])
def test_tokens_of_a_slice_that_ends_in_an_english_ending(texts):
    import pyarrow as pa

    from wattloom.llm.words import utf8

    coder = packing.Tokeniser(packing.default_vocabulary())
    ids, first = coder.encode(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [coder.library.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def test_packing_places_every_piece_once(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark, near_copies(6, 6))
    rows = packing.packed_documents(docs).collect()
    library = Tokenizer.from_file(packing.default_vocabulary())
    whole = {}
    for r in docs.collect():
        whole.setdefault(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [packing.END_ID])
    by_sequence: dict = {}
    for r in rows:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        assert r.length == packing.CAPACITY or r.piece == 0
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    n_docs = docs.count()
    assert sum(r.piece == 0 for r in rows) == n_docs
    assert packing.packed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_covers_the_histogram_tightly(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(v): int(c) for v, c in zip(rng.integers(1, 1025, 600), rng.integers(1, 400, 600))}
    rows = packing.plan(histogram)
    seen: dict = {}
    for length, lo, hi, _, _ in sorted(rows):
        assert seen.get(length, 0) == lo
        seen[length] = hi
    assert seen == histogram
    total = sum(k * v for k, v in histogram.items())
    over_half = sum(v for k, v in histogram.items() if k > packing.CAPACITY // 2)  # no two of these share a sequence
    assert max(s + hi - lo for _, lo, hi, s, _ in rows) <= 1.06 * max(total / packing.CAPACITY, over_half) + 2


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def brute_neighbours(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            s = sorted(((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w)), i) for i, w in rows if i != q))
            out[q] = [i for _, i in s[:k]]
    return out


def test_neighbours_recall_and_order(spark):
    x = np.random.default_rng(0).normal(size=(1200, 24)).astype(np.float32)
    x[100:180] = x[100]  # ties
    x[200:210] *= 3  # norms differ
    rows = list(enumerate(x.tolist()))
    got: dict = {}
    for r in neighbours.nearest(vectors(spark, x), __import__("pyspark").sql.functions.expr("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-9
    want = brute_neighbours(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    assert got[100] == want[100]


EVERY_20TH = "vec_id % 20 = 0"


def recall_of(spark, x):
    got: dict = {}
    for r in neighbours.nearest(vectors(spark, x), F.expr(EVERY_20TH)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    met = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        met.append(len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:20].tolist())) / 20)
    assert set(got) == set(range(0, len(x), 20)) and all(len(v) == 20 for v in got.values())
    return np.mean(met)


def test_neighbours_recall_of_unequal_norms_with_an_outlier(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x *= rng.lognormal(0, 0.5, 1500)[:, None] / np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 50 / np.linalg.norm(x[7])
    assert recall_of(spark, x.astype(np.float32)) >= 0.9


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_neighbours_recall_by_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    assert recall_of(spark, rng.normal(size=(2400, dim)).astype(np.float32)) >= 0.9
    near = rng.normal(size=(80, dim))[rng.integers(0, 80, 2400)] + rng.normal(size=(2400, dim)) * 0.5
    assert recall_of(spark, near.astype(np.float32)) >= 0.9


def test_neighbours_share_of_candidates_falls_as_the_table_grows(spark, monkeypatch):
    shares, plain = [], neighbours.choose

    def noted(q, x, slot, index, *rest):
        effort = plain(q, x, slot, index, *rest)
        shares.append(max(effort.tables * p / index.size for p in effort.probes.values()))
        return effort

    monkeypatch.setattr(neighbours, "choose", noted)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 30_000)] + rng.normal(size=(30_000, 16)) * 0.3
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    for n in (1000, 6000, 30_000):
        assert recall_of(spark, x[:n]) >= 0.9
    assert shares[0] > 1.5 * shares[1] > 2 * shares[2], shares


def test_neighbours_of_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(20, None), (21, [0.0, 0.0]), (22, [nan, 1.0]), (23, [inf, 1.0]), (24, [None, 1.0]), (25, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [1.0, 1.0]), (41, [1.0, 1.0])]
    df = vectors(spark, [[1, 0], [0, 1], [1, 1]], odd)
    cond = __import__("pyspark").sql.functions.expr("vec_id % 20 = 0")
    rows = [tuple(r) for r in neighbours.nearest(df, cond).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 2), (0, 2, 40), (0, 3, 41), (0, 4, 1), (40, 1, 2), (40, 2, 41), (40, 3, 0), (40, 4, 1)]
    assert neighbours.nearest(df.limit(0), cond).count() == 0


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(8)
    for n in (1, 5, 700, 1100, 5000):
        a = np.unique(rng.integers(0, 1 << 50, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 50, n // 5 + 1, dtype=np.uint64)]))
        x, y = (np.frombuffer(s, np.uint8)[None] for s in jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        c = min(x.shape[1], y.shape[1])
        assert np.abs(jaccard.folded(x, c) - jaccard.folded(y, c)).sum() <= len(np.setxor1d(a, b))
