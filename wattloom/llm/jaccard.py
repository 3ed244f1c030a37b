"""N-gram Jaccard join by partitioning the universe of shingles, exact at the threshold.

Two sets of sizes s <= t with Jaccard similarity of at least 4/5 differ in at most (s + t) / 9 shingles.
Sizes fall into bands, each 5/4 as wide as the one before; a space pairs the sets of a band with those
of the same and the next band and has a largest difference H. In a space every shingle falls into one
of m segments, and a set's part in a segment is one signature. If sets differ in at most H shingles,
at most H segments differ, so among more than H segments that are not empty in both, one is equal.

Allocation by cost: an empty segment costs nothing and gives nothing, a filled one costs one signature.
A set that fills H + 1 segments is thereby safe with any partner. One that fills fewer also gives its
one-deletion neighbourhoods, cheapest segments first in the count of what they add, by which parts that
differ in one shingle meet; should even these not reach H + 1, it joins the space's list of leftovers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import components, cut_lineage, marked, per_batch, per_group, record

U64 = words.U64
SHINGLE = 5
#: Shingle hashes keep so many bits; above them stands the text's place in its slice while sorting.
HASH_BITS = 50
#: Low bits of a set's identity that say its size, on a log scale.
SIZE_BITS, SIZE_STEPS = 12, 240.0


def bands() -> np.ndarray:
    """Smallest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out)


BANDS = bands()
#: For each space the largest difference of a pair, and how many segments it has.
MOST = (BANDS[1:] - 1) // 4
SEGMENTS = np.where(MOST == 0, 1, np.ceil(BANDS[:-1] * 0.36 + 4)).astype(np.int64)


def shingle_sets(texts: pa.Array):
    """(first text, last text, sorted shingle hashes, bounds) by slices.

    The shingles of a text are its runs of five words; of a text with fewer, but not none, all of it.
    """
    for i, j, _, w in words.runs(texts, words.SPACED):
        n = j - i
        start = words.gram_starts(w.first, SHINGLE)
        h = words.gram_hash(w.hash, SHINGLE)[start] if len(start) else np.zeros(0, U64)
        owner = np.searchsorted(w.first, start, "right") - 1
        short = np.flatnonzero((w.counts() > 0) & (w.counts() < SHINGLE))
        whole = [words.gram_hash(w.hash[w.first[t] : w.first[t + 1]], int(w.counts()[t]))[0] for t in short.tolist()]
        h = np.concatenate([h, np.array(whole, U64)]) >> U64(64 - HASH_BITS)
        owner = np.concatenate([owner, short]).astype(np.uint64)
        for lo in range(0, n, 1 << (64 - HASH_BITS)):
            hi = min(n, lo + (1 << (64 - HASH_BITS)))
            mine = (owner >= lo) & (owner < hi) if n > hi - lo else slice(None)
            key = np.unique(((owner[mine] - U64(lo)) << U64(HASH_BITS)) | h[mine])
            bounds = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << U64(HASH_BITS))
            yield i + lo, i + hi, key & U64((1 << HASH_BITS) - 1), bounds


def identities(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Identity of each set: a hash of its shingles, and its size in the low bits; 0 for an empty one."""
    n = np.diff(bounds)
    total = np.zeros(len(n), U64)
    owner = np.repeat(np.arange(len(n)), n)
    np.add.at(total, owner, words.mix(shingles))
    size = np.minimum(np.log(np.maximum(n, 1)) * SIZE_STEPS, (1 << SIZE_BITS) - 1).astype(np.uint64)
    out = (words.mix(total + n.astype(np.uint64)) & ~U64((1 << SIZE_BITS) - 1)) | size
    return np.where(n > 0, out, U64(0))


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets and the set that each is of, for the set's own space and the one below."""
    n = np.diff(bounds)
    band = np.searchsorted(BANDS, n, "right") - 1
    spread = words.mix(shingles ^ U64(0x5BF03635)) >> U64(32)
    body = words.mix(shingles)
    all_sig, all_own = [], []
    for down in (0, 1):
        space = band - down
        use = np.flatnonzero((n > 0) & (space >= 0))
        if not len(use):
            continue
        m = np.zeros(len(n), np.int64)
        m[use] = SEGMENTS[space[use]]
        base = np.cumsum(m) - m
        owner = np.repeat(np.arange(len(n)), n)
        pick = m[owner] > 0
        own, part = owner[pick], body[pick]
        at = base[own] + ((spread[pick] * m[own].astype(np.uint64)) >> U64(32)).astype(np.int64)
        sums = np.zeros(int(m.sum()), U64)
        np.add.at(sums, at, part)
        count = np.bincount(at, minlength=len(sums))
        whose = np.repeat(np.arange(len(n)), m)
        place = words.mix((np.arange(len(sums)) - base[whose]).astype(np.uint64) * U64(0x2545F491) + space[whose].astype(np.uint64))
        filled = count > 0
        all_sig.append(words.mix(sums[filled] ^ place[filled]))
        all_own.append(whose[filled])
        safe = np.bincount(whose[filled], minlength=len(n)) > MOST[np.maximum(space, 0)]
        weak = (m > 0) & ~safe
        if weak.any():
            # one deletion of each part of two or more
            gone = weak[own] & (count[at] > 1)
            all_sig.append(words.mix((sums[at[gone]] - part[gone]) ^ place[at[gone]]))
            all_own.append(own[gone])
            reach = np.bincount(whose, np.minimum(count, 2), len(n))
            rest = np.flatnonzero(weak & (reach <= MOST[np.maximum(space, 0)]))
            all_sig.append(words.mix(space[rest].astype(np.uint64) + U64(0xA5A5A5A5)))
            all_own.append(rest)
    if not all_sig:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(all_sig), np.concatenate(all_own)


#: Counters of a small set's sketch; a larger set has the power of two that leaves at most so many shingles to a counter.
COUNTERS, PER_COUNTER = 128, 8
#: Members of a signature that are paired directly; in a larger group sketches decide first which may belong together.
PAIRED = 24
#: Signatures that a mapper gathers before it sends them, and that a reducer gets on average.
SENT, GATHERED = 1 << 18, 600_000
#: Members of a side of a large group's tile, and rows of such tiles in one task.
GROUP_TILE, GROUP_ROWS = 2_048, 32_768
#: Shingles and sets of a side of a cluster's tile, shingles that one task gets, and how many are multiplied at once.
TILE, TILE_SETS, TASK_SHINGLES, COLUMNS = 300_000, 2_000, 1_000_000, 4_096
#: Steps of the size code that two sets at the threshold may lie apart.
SIZE_GAP = math.ceil(math.log(1.25) * SIZE_STEPS) + 1


def counters_of(n: np.ndarray) -> np.ndarray:
    """How many counters the sketch of a set of ``n`` shingles has."""
    return np.maximum(COUNTERS, 1 << np.ceil(np.log2(np.maximum(n, 1) / PER_COUNTER)).clip(0).astype(np.int64))


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set how many of its shingles fall into each counter, as bytes.

    Counters that differ by d in two sets mean that the sets differ in d shingles at least; what a byte
    can't hold only makes that bound smaller.
    """
    n = np.diff(bounds)
    size = counters_of(n)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(n)), n)
    at = first[owner] + (words.mix(shingles ^ U64(0x77)) % size[owner].astype(np.uint64)).astype(np.int64)
    flat = np.minimum(np.bincount(at, minlength=int(first[-1])), 255).astype(np.uint8)
    return [flat[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist())]


def folded(counters: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows) brought to ``size`` counters, which divides their own number."""
    return counters.astype(np.int16).reshape(len(counters), -1, size).sum(1, dtype=np.int16)


SETS = "doc_id long, key long, n long, set_id long, sketch binary"


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, set_id, sketch) of every row; key is a hash of the text, and an empty set has set_id 0."""

    def work(batch: pa.RecordBatch) -> dict:
        n, ids, counters = [], [], []
        for _, _, h, bounds in shingle_sets(batch.column("text")):
            n.append(np.diff(bounds))
            ids.append(identities(h, bounds))
            counters += sketches(h, bounds)
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n": np.concatenate(n), "set_id": np.concatenate(ids), "sketch": counters}

    return per_batch(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"), SETS, work)


def _by_signature(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, set) rows in order, and the bounds of each signature's rows."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids = sig[new], ids[new]
    return sig, ids, np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


PARTS = "bucket long, sig binary, ids binary"
MET = "a long, b long, grouped boolean"


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """Sets that share a signature: pairs (a, b) of compatible size from small groups, else rows (a = signature, b = set) marked as grouped.

    A mapper sends each distinct set once, so copies do not pile up at a reducer.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ids, held = [], [], 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            s, i = np.concatenate(sig), np.concatenate(ids)
            bucket = (s % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            s, i = s[order], i[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut)).tolist()
            part = lambda x: [x[cut[k] : cut[k + 1]].tobytes() for k in full]
            return record({"bucket": full, "sig": part(s), "ids": part(i)}, PARTS)

        for batch in batches:
            for _, _, h, bounds in shingle_sets(batch.column("text")):
                whose = identities(h, bounds)
                fresh = np.array([x not in seen for x in whose.tolist()]) & (whose > 0)
                first = np.zeros(len(whose), bool)
                first[np.unique(whose, return_index=True)[1]] = True
                fresh &= first
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.update(whose[fresh].tolist())
                size = np.where(fresh, np.diff(bounds), 0)
                kept = np.repeat(fresh, np.diff(bounds))
                s, own = signatures(h[kept], np.concatenate([[0], np.cumsum(size)]))
                sig.append(s)
                ids.append(whose[own])
                held += len(s)
                if held > SENT:
                    yield flush()
                    sig, ids, held = [], [], 0
        if held:
            yield flush()

    def meet(rows: pa.Table) -> dict:
        whole = lambda c: np.frombuffer(b"".join(rows[c].to_pylist()), np.uint64)
        sig, ids, bounds = _by_signature(whole("sig"), whole("ids"))
        size = np.diff(bounds)
        large = np.repeat(size > PAIRED, size)
        a, b = sig[large], ids[large]
        code = (ids & U64((1 << SIZE_BITS) - 1)).astype(np.int64)
        # one shift after the other over the rows of small groups, so a pair is two rows some places apart
        small = np.repeat((size > 1) & (size <= PAIRED), size)
        ids, code, group = ids[small], code[small], np.repeat(np.arange(len(size)), size)[small]
        p, q = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for gap in range(1, min(PAIRED, len(ids))):
            ok = (group[gap:] == group[:-gap]) & (np.abs(code[gap:] - code[:-gap]) <= SIZE_GAP)
            p.append(ids[:-gap][ok])
            q.append(ids[gap:][ok])
        p, q = _distinct_pairs(np.concatenate(p), np.concatenate(q))
        return {"a": np.concatenate([a, p]), "b": np.concatenate([b, q]), "grouped": np.arange(len(a) + len(p)) < len(a)}

    sent = docs.select("text").mapInArrow(send, PARTS)
    return per_group(sent, ["bucket"], MET, meet)


def _tiled(rows: DataFrame, key: str, member: str, weight: Column, side: int, per_task: int) -> DataFrame:
    """``rows`` of groups cut into tiles: side `own`, pair of sides `i` <= `j`, and the task `part` that gets them.

    Sides weigh about ``side`` each, tasks about ``per_task``.

    A group of several sides sends each row once to every pair of sides that it is part of, so that no
    group has to fit one task.
    """
    sizes = rows.groupBy(key).agg(F.sum(weight).alias("weight"), F.ceil(F.sum(weight) / side).cast("int").alias("sides"))
    copies = sizes.agg(F.sum(F.col("weight") * F.col("sides"))).first()[0] or 0
    own = F.pmod(F.xxhash64(member), F.col("sides")).cast("int")
    spread = rows.join(sizes.drop("weight"), key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("sides", "other")
    return spread.withColumn("part", F.pmod(F.xxhash64(key, "i", "j"), F.lit(max(1, math.ceil(copies / per_task)))))


def _runs_of(rows: pa.Table, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Runs of equal keys of sorted rows."""
    columns = [rows[c].to_numpy() for c in keys]
    edge = np.ones(rows.num_rows + 1, bool)
    edge[1:-1] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(edge)
    yield from zip(at[:-1].tolist(), at[1:].tolist())


def uniting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, in their order, that join what those before them had not joined yet."""
    if not len(a):
        return a, b
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(int(at.max()) + 1))
    keep = []
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def near_forest(counters: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect the same members as all pairs do that the sketches leave open.

    Everyone is held against the first member; only those it can't be near to are held against all.
    """
    def open_to(k: int) -> np.ndarray:
        return np.flatnonzero(9 * np.abs(counters - counters[k]).sum(1, dtype=np.int64) <= n + n[k])

    label = np.arange(len(n))
    a, b = [], []
    first = open_to(0)
    label[first] = 0
    a += [0] * (len(first) - 1)
    b += first[first != 0].tolist()
    for k in np.flatnonzero(label != 0).tolist():
        found = open_to(k)
        found = found[label[found] != label[k]]
        if len(found):
            roots, at = np.unique(label[found], return_index=True)
            a += [k] * len(at)
            b += found[at].tolist()
            label[np.isin(label, roots)] = label[k]
    return a, b


def _grouped_edges(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) within large groups (a = signature, b = set).

    Of signatures with the same members, told by a sum of their hashes, one is enough.
    """
    rows = grouped.select(F.col("a").alias("sig"), F.col("b").alias("set_id"))
    lists = rows.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("h"))
    rows = rows.join(lists.groupBy("n", "h").agg(F.min("sig").alias("sig")).select("sig"), "sig")
    rows = _tiled(rows, "sig", "set_id", F.lit(1), GROUP_TILE, GROUP_ROWS).join(sets.select("set_id", "n", "sketch"), "set_id")

    def work(rows: pa.Table) -> dict:
        keys = ("sig", "i", "j")
        rows = rows.combine_chunks().sort_by([(c, "ascending") for c in (*keys, "set_id")])
        ids, n = rows["set_id"].to_numpy(), rows["n"].to_numpy()
        size, sketch = counters_of(n), rows["sketch"]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in _runs_of(rows, keys):
            # sets at the threshold have equally many counters or one twice as many as the other
            for c in np.unique(size[lo:hi]).tolist():
                mine = lo + np.flatnonzero((size[lo:hi] == c) | (size[lo:hi] == 2 * c))
                if len(mine) > 1:
                    counters = np.concatenate([folded(np.frombuffer(sketch[k].as_buffer(), np.uint8)[None], c) for k in mine.tolist()])
                    p, q = near_forest(counters, n[mine])
                    a.append(ids[mine[p]])
                    b.append(ids[mine[q]])
        # the signatures of one family of near copies hold much the same members: one forest for all
        a, b = uniting(np.concatenate(a), np.concatenate(b))
        return {"a": a, "b": b}

    return per_group(rows.select("part", "sig", "i", "j", "set_id", "n", "sketch"), ["part"], "a long, b long", work)


def _may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule the threshold out: counters that differ by d mean a difference of d at least."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def work(batch: pa.RecordBatch) -> dict:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        size = np.stack([counters_of(n_a), counters_of(n_b)], 1)
        keep = []
        for c_a, c_b in np.unique(size, axis=0).tolist():
            rows = np.flatnonzero((size == (c_a, c_b)).all(1))
            for at in range(0, len(rows), 1024):
                part = pa.array(rows[at : at + 1024])
                x, y = (np.frombuffer(b"".join(batch.column(c).take(part).to_pylist()), np.uint8).reshape(len(part), -1) for c in ("s_a", "s_b"))
                gap = np.abs(folded(x, min(c_a, c_b)) - folded(y, min(c_a, c_b))).sum(1, dtype=np.int64)
                mine = rows[at : at + 1024]
                keep.append(mine[9 * gap <= n_a[mine] + n_b[mine]])
        keep = pa.array(np.concatenate(keep))
        a, b = uniting(*(batch.column(c).take(keep).to_numpy() for c in ("a", "b")))
        return {"a": a, "b": b}

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return per_batch(joined.select("a", "b", "n_a", "s_a", "n_b", "s_b"), "a long, b long", work)


def compare(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of sets at the threshold, by exact intersection sizes."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
    else:
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, back, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[back] > 1
        number = np.cumsum(times > 1) - 1
        column, row = number[back[shared]], row[shared]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        common = np.zeros((len(sets), len(sets)))
        for lo in range(0, int(number[-1]) + 1, COLUMNS):
            a, z = np.searchsorted(column, [lo, lo + COLUMNS])
            block = np.zeros((len(sets), COLUMNS), np.float32)
            block[row[a:z], column[a:z] - lo] = 1
            common += block @ block.T
    both = size[:, None] + size[None, :]
    return np.nonzero(np.triu(100 * common >= 80 * (both - common), 1))


def pair_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b) of members below ``n``, in order of a, connect the same members as all of them."""
    label, keep = np.arange(n), []
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        own = label[a[lo]]
        new = lo + np.flatnonzero(label[b[lo:hi]] != own)
        if len(new):
            roots, first = np.unique(label[b[new]], return_index=True)
            keep.append(new[first])
            label[np.isin(label, roots)] = own
    return np.concatenate(keep) if keep else np.zeros(0, np.int64)


#: An edge (a, b), or with b null what one task adds to the number of rows that a links with.
LINKS = "a long, b long, weight long"


def links(clusters: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """LINKS of the sets in clusters (node, root): every pair is compared in one tile, no pair leaves its task.

    A task gives edges that connect what its pairs connect, and one sum per member. Texts of members go to
    the task that compares them, which makes their shingles anew.
    """
    members = clusters.join(sets.select(F.col("set_id").alias("node"), F.col("doc_id").alias("doc"), "rows", "n"), "node")
    members = cut_lineage(members, "members")
    texts = marked(docs.select("doc_id", "text"), "doc_id", members.select("doc")).where("_wl_may").select("doc_id", "text")
    tiles = _tiled(members, "root", "node", F.greatest("n", F.lit(TILE // TILE_SETS)), TILE, TASK_SHINGLES)
    whole = tiles.join(texts, F.col("doc") == F.col("doc_id")).select("part", "root", "i", "j", "own", "node", "rows", "text")

    def work(rows: pa.Table) -> dict:
        keys = ("root", "i", "j")
        rows = rows.combine_chunks().sort_by([(c, "ascending") for c in (*keys, "node")])
        node, own, weight, side = (rows[c].to_numpy() for c in ("node", "own", "rows", "i"))
        other = rows["j"].to_numpy()
        a, b, who, more = ([np.zeros(0, np.int64)] for _ in range(4))
        for lo, hi in _runs_of(rows, keys):
            sets, ids = [], []
            for _, _, h, bounds in shingle_sets(rows["text"][lo:hi]):
                sets += [h[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
                ids.append(identities(h, bounds))
            # an id may have several rows: only one of the member's own text counts
            fits = np.concatenate(ids).view(np.int64) == node[lo:hi]
            keep = [k for k in range(hi - lo) if fits[k] and not (k and fits[k - 1] and node[lo + k - 1] == node[lo + k])]
            if len(keep) < 2:
                continue
            x, y = compare([sets[k] for k in keep])
            at = lo + np.array(keep)
            if side[lo] != other[lo]:  # pairs within a side are found where the tile meets itself
                across = own[at[x]] != own[at[y]]
                x, y = x[across], y[across]
            edge = pair_forest(x, y, len(at))
            a.append(node[at[x[edge]]])
            b.append(node[at[y[edge]]])
            who.append(node[at])
            more.append((np.bincount(x, weight[at[y]], len(at)) + np.bincount(y, weight[at[x]], len(at))).astype(np.int64))
        a, b = uniting(np.concatenate(a), np.concatenate(b))
        member, back = np.unique(np.concatenate(who), return_inverse=True)
        total = np.bincount(back, np.concatenate(more), len(member)).astype(np.int64)
        some = total > 0
        ends = pa.concat_arrays([pa.array(b), pa.nulls(int(some.sum()), pa.int64())])
        return {"a": np.concatenate([a, member[some]]), "b": ends, "weight": np.concatenate([np.zeros(len(a), np.int64), total[some]])}

    return per_group(whole, ["part"], LINKS, work)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, n_links) of every row of ``docs``; key is a hash of its text.

    ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the number of other rows that
    a row links with, equal sets included. Null and empty texts have no shingles and link with nothing.
    A row without id is a component of null and takes no part. Ids may repeat; each row counts by its text.
    """
    every = cut_lineage(document_sets(docs), "sets")
    named = every.where((F.col("set_id") != 0) & F.col("doc_id").isNotNull())
    sets = named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = cut_lineage(sets, "distinct")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total * 0.65 / GATHERED))
    met = cut_lineage(candidates(docs.where(F.col("doc_id").isNotNull()), buckets), "met")
    pairs = met.where("NOT grouped").select("a", "b").distinct()
    near = _may_link(pairs, sets).union(_grouped_edges(met.where("grouped"), sets))
    found = cut_lineage(links(components(near, "near"), sets, docs.where(F.col("doc_id").isNotNull())), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"), "linked")
    smallest = roots.join(sets.select(F.col("set_id").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w"))
    linked = roots.join(smallest, "root").join(degree, "node").select("node", "least", "w")
    classes = sets.join(linked, sets["set_id"] == linked["node"], "left").select(
        "set_id", F.coalesce("least", "doc_id").alias("component_id"), (F.col("rows") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")
    )
    out = every.drop("sketch").join(classes, ["set_id"], "left")
    alone = F.col("set_id") == 0
    return out.select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull() | alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def surplus(joined: DataFrame) -> DataFrame:
    """(doc_id, key, keep) for the rows of :func:`join` that don't all stay when each component keeps one row, of its smallest id.

    Of repeated rows of that id the one of the smallest key stays. Rows without id or words are no group.
    """
    rows = joined.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "key", "component_id")
    many = rows.groupBy("doc_id", "component_id").agg(F.count("*").alias("rows"), F.min("key").alias("first")).where("component_id <> doc_id OR rows > 1")
    keep = (F.col("component_id") == F.col("doc_id")) & (F.col("key") == F.col("first"))
    return rows.distinct().join(many, ["doc_id", "component_id"]).select("doc_id", "key", keep.cast("int").alias("keep"))
