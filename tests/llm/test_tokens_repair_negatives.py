"""Token counts, conversation repair and hard negatives: against the library, brute force and the DuckDB twins."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import awkward
from wattloom.llm import negatives, queries, repair, tokencounts


# --- token counts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencounts.default_vocabulary())


def odd_texts(n: int) -> list:
    rng = random.Random(11)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "日", "\U0001f600", ".", "1", "　", "\x00", "ing", "tion", "<s>", "</s>", "́", "﻿"]
    texts = [None, "", " ", "  ", "▁", "a ", " a", "x" * 5000, " " * 70, "<unk> <s>", "日本語 テスト", "é é"]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_pretokens_add_up_to_the_library(library):
    texts = odd_texts(800) + [f"{chr(c)}a {chr(c)} b{chr(c)}" for c in itertools.chain(range(0x300), range(0x1F000, 0x1F100))]
    known, none = tokencounts.Counter(tokencounts.default_vocabulary()), (np.zeros(0, np.uint64), np.zeros(0, np.int16))
    for _ in range(2):  # the second time everything is remembered
        for i, j, own, start, h, first in tokencounts.pretokens(pa.array(texts)):
            distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
            lengths = known.lengths(distinct, own, start[at], np.append(start[1:], len(own))[at], none)
            before = np.concatenate([[0], np.cumsum(lengths[back])])
            assert (before[first[1:]] - before[first[:-1]]).tolist() == [len(library.encode(t or "")) for t in texts[i:j]]


def test_forgetting_changes_no_count(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "REMEMBERED", 8)
    known, none = tokencounts.Counter(tokencounts.default_vocabulary()), (np.zeros(0, np.uint64), np.zeros(0, np.int16))
    for text in odd_texts(200):
        for _, _, own, start, h, _ in tokencounts.pretokens(pa.array([text], pa.string())):
            distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
            lengths = known.lengths(distinct, own, start[at], np.append(start[1:], len(own))[at], none)
            assert int(lengths[back].sum()) == len(library.encode(text or ""))
    assert sum(len(x[0]) for x in known.levels) <= 8 + 40


def test_token_counts_of_a_table(spark, library):
    texts = odd_texts(300)
    more = [(100 + k, t, "en", "s", 1) for k, t in enumerate(texts)]
    more += [(900, "w " * 4096, "en", "s", 1), (901, "w " * 4095 + "w", "en", "s", 1)]
    docs = awkward(spark, more).repartition(5)
    for limit in (4096, 3):
        rows = tokencounts.count(docs, limit=limit).collect()
        want = sorted(((d.doc_id, len((d.text or "").encode()), len(library.encode(d.text or "")), len(library.encode(d.text or "")) > limit) for d in docs.collect()), key=str)
        assert sorted((tuple(r) for r in rows), key=str) == want
    assert tokencounts.count(docs.where("false")).collect() == []


def test_frequent_table_holds_the_frequent_pretokens(spark):
    docs = spark.createDataFrame([(k, "of the of the of " + " ".join(f"q{k}x{j}" for j in range(40))) for k in range(300)], "doc_id long, text string").repartition(7)
    hashes, lengths = tokencounts.frequent(docs, tokencounts.default_vocabulary(), size=4)
    assert len(hashes) == 4
    for _, _, _, _, h, _ in tokencounts.pretokens(pa.array(["of the"])):
        at = np.searchsorted(hashes, h)
        assert (hashes[at] == h).all() and lengths[at].tolist() == [1, 1]


# --- conversation repair


def every_audit(turns, limit):
    """All edits of ``turns`` with at most ``limit`` insertions that give an accepted row of roles, as (cost, audit)."""

    def go(i, roles, cost, audit, added):
        if i == len(turns) and roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2) and roles.count("s") <= 1 and roles != "s":
            yield cost, audit
        if added < limit:
            for r in "ua":
                yield from go(i, roles + r, cost + 3, audit + "I", added + 1)
        if i < len(turns):
            initial, fault = turns[i]
            yield from go(i + 1, roles, cost + 4, audit + "D", added)
            if fault in (repair.OK, repair.CUT_OFF):
                extra = 3 * (fault == repair.CUT_OFF)
                if initial in ("s", "u", "a"):
                    yield from go(i + 1, roles + initial, cost + extra, audit + "K", added)
                for r in "ua":
                    yield from go(i + 1, roles + r, cost + extra + 3, audit + "R", added)

    return go(0, "", 0, "", 0)


def test_search_finds_the_cheapest_edits():
    rng = random.Random(5)
    for _ in range(150):
        turns = [repair.Turn(rng.choice(["s", "u", "a", " ", "x"]), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(4))]
        assert repair.search(turns) == min(every_audit(turns, 3))


def test_blocks_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        turns = [repair.Turn(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(2, 14))]
        cut = rng.randrange(1, len(turns))
        tails = {0: "", 1: "II", 2: "I", 3: ""}
        ways = []
        for a, b in itertools.product(repair.STATES, repeat=2):
            x, y = repair.search(turns[:cut], 0, a), repair.search(turns[cut:], a, b)
            if x and y:
                ways.append((x[0] + y[0] + 3 * len(tails[b]), x[1] + y[1] + tails[b]))
        assert min(ways) == repair.search(turns)


def test_search_stays_linear_on_long_conversations():
    for pattern in ("s", "u", "a", "x", "ua", "sua", "uuas"):
        turns = [repair.Turn(pattern[k % len(pattern)], (0, 0, 3, 0, 1, 2)[k % 6]) for k in range(2000)]
        cost, audit = repair.search(turns)
        assert sum(audit.count(e) for e in "KRD") == 2000 and cost <= 4 * 2000


def odd_conversations(spark, long=0):
    rng = random.Random(8)
    texts = ["Yes.", "No", "", " \t", "What?", "go on", None, "…", "end!  \n", "a.b"]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "uncle"]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.") for c in (None, *range(60)) for _ in range(rng.randrange(1, 12))]
    rows += [(1000, k // 2, ("user", "assistant", "system")[k % 7 % 3], rng.choice(["Fine.", "Cut", f"Row {k}."])) for k in range(long)]
    rows += rows[:20] + [(2000, 0, "user", "dropped?")] + [(3000, None, None, None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "1 AS place", "2 AS n", "3 AS cost")


def by_hand(rows):
    """The report of damaged rows by plain Python; the edits are left to the search, which is tested on its own."""
    kept = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if kind == 1 else said[3].translate({ord(c): None for c in ".!?"}) if kind == 2 else said[3]
        kept += [(conv, turn, "user" if kind == 4 else said[2], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in kept if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = repair.search([repair.Turn(r[1][:1], f) for r, f in zip(own, faults)])
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in repair.messages([r[1:] for r in own], audit))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.repaired_conversations(frame).collect()}


def test_reports_of_odd_conversations(spark):
    frame = odd_conversations(spark)
    assert reported(frame) == by_hand([tuple(r)[:4] for r in frame.collect()])
    assert queries.repaired_conversations(frame.where("false")).collect() == []


def test_long_conversations_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "WHOLE_ROWS", 6)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 5)
    frame = odd_conversations(spark, long=400)
    assert reported(frame) == by_hand([tuple(r)[:4] for r in frame.collect()])


def test_repaired_turns_are_those_of_the_hash(spark, monkeypatch):
    damaged = queries.damaged(odd_conversations(spark, long=100))
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.report(damaged).collect()}
    for rows in (2048, 6):
        monkeypatch.setattr(repair, "WHOLE_ROWS", rows)
        turns: dict = {c: [] for c in hashes}
        for r in sorted(repair.repaired(damaged).collect(), key=lambda r: r.place):
            assert r.place == len(turns[r.conv_id])
            turns[r.conv_id].append((r.role, r.text))
        assert {c: hashlib.sha256(repair.written(t)).hexdigest() for c, t in turns.items()} == hashes


def test_repair_twin_on_odd_rows(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    frame = odd_conversations(spark).drop("part", "place", "n", "cost")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = {r[0]: r[1:] for r in con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.ORACLE['op12_conversation_repair']})").fetchall()}
    assert got == reported(frame)


# --- hard negatives


@pytest.mark.parametrize("dim, most", [(64, 200), (1, 3), (0, 1), (3000, 2000), (5, 1 << 29), (1, (1 << 31) - 1)])
def test_residue_products_are_exact(dim, most):
    rng = np.random.default_rng(dim + 1)
    a, b = (np.floor(rng.uniform(-most, most, (n, dim))) for n in (5, 9))
    a[0], b[0] = most, -most
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert negatives.scores(a, b).tolist() == want


def odd_vectors(spark):
    rng = random.Random(9)
    vec = lambda d=6: [rng.choice([rng.uniform(-1, 1), 0.0, 0.5, -0.25]) for _ in range(d)]
    same = vec()
    rows = [(k, vec(), rng.randrange(4)) for k in range(0, 420)]
    rows += [(500 + k, same, k % 3) for k in range(150)] + [(100, rows[100][1], rows[100][2])] * 2 + [(300, vec(), 1)]
    rows += [(600, None, 1), (601, [], 1), (700, [], 1), (702, [], 2), (703, [0.1, None] + [0.0] * 4, 1), (704, [float("nan")] * 6, 1), (705, [float("inf")] * 6, 1), (706, vec(), None)]
    rows += [(800, vec(3), 1), (801, vec(3), 1), (802, vec(3), 2), (-100, vec(), 2), (None, vec(), 2), (900, [0.0] * 6, 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS window", "2 AS anchor", "3 AS score", "4 AS dim")


def test_negatives_of_odd_vectors(spark, tmp_path, monkeypatch):
    frame = odd_vectors(spark)
    path = str(tmp_path / "embeddings.parquet")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op13_hard_negatives']})").fetchall())
    assert len(want) > 100
    got = lambda: sorted(tuple(r[n] for n in names) for r in queries.hard_negatives(spark.read.parquet(path)).collect())
    assert got() == want
    # many slices, cells and blocks
    for name, value in (("SLICE_ROWS", 16), ("CELL_SLICES", 2), ("BLOCK_ROWS", 2), ("HELD_BLOCKS", 1)):
        monkeypatch.setattr(negatives, name, value)
    assert got() == want
    assert queries.hard_negatives(frame.where("false")).collect() == []
