"""Token sequences of fixed length: tokenising, cutting, and packing by non-negative least squares.

Packing needs only how many pieces have each length. Patterns of at most three lengths that fill a
sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares
(coordinate descent), rounded within what there is, and the pieces left over packed best-fit on
counts. The plan says for each length which ranks go where; its size depends on the capacity alone.
Pieces get their rank within their length from counts over hash buckets, so no length and no group
of copies has to pass one task.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import collect_rows, cut_lineage, record

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 1 << 21
#: Documents and bytes of text tokenised at once.
PART_ROWS, PART_BYTES = 1024, 1 << 18
#: Pieces of a length in a hash bucket, on average at most.
BUCKET_ROWS = 50_000

#: Shares of the shortest pieces that the fit leaves for the leftovers; the best plan of these counts.
HELD_BACK = (0.3, 0.5, 0.7)

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Code points classified at once.
CLASS_STEP = 1 << 12


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point; those that no Unicode version has assigned yet are unsure."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    # step by step, as a string for each of all code points would take 100 MB of every worker
    for begin in range(0, 0x110000, CLASS_STEP):
        every = "".join(chr(c) for c in range(begin, begin + CLASS_STEP) if not 0xD800 <= c < 0xE000)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE), (r"\p{Cn}", UNSURE)):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        own = table[begin : begin + CLASS_STEP]
        own[[c for c in np.flatnonzero(own != UNSURE).tolist() if unicodedata.category(chr(begin + c)) == "Cn"]] = UNSURE
    return table


#: English endings that the vocabulary's splitting rule cuts off, as code points after the apostrophe.
ENDINGS = [tuple(map(ord, e)) for e in ("s", "t", "re", "ve", "m", "ll", "d")]


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the words that a byte-level vocabulary never merges across.

    The rule: an optional space with letters, numbers or signs; white space before that; English endings.
    ``first`` bounds the texts in ``cp``.
    """
    n = len(cp)
    kind = char_classes()[cp]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    run = text_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    solid = kind != SPACE
    start = run.copy()
    # the last white space before a word: a blank joins it, anything else stands alone
    before = np.flatnonzero(run & solid & ~text_start[:n]) - 1
    before = before[kind[before] == SPACE]
    blank = cp[before] == 32
    start[before] = True
    start[before[blank] + 1] = False
    # endings
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[run[quote]]
    for ending in ENDINGS:
        ok = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            ok = ok[(cp[ok + k] == c) & ~text_start[ok + k]]
        start[ok + 1] = False
        after = ok + 1 + len(ending)
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Tokeniser:
    """Token ids of whole texts, each distinct word encoded once per worker.

    ``texts`` are split by :func:`word_starts`; the words not met before are encoded together by the
    vocabulary's own library. A text with a code point of unsure class is given to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.newline = self._encode("\n")[0]
        self.forget()

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        #: Known words as runs of (sorted hash, first id, how many ids); later runs are shorter.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, found: list[str], blank: np.ndarray) -> None:
        """Adds words that aren't known yet; ``blank`` marks those of white space."""
        begin, size = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        solid, base = np.flatnonzero(~blank), len(self.ids)
        parts = [self.ids]
        if len(solid):
            # a line break between words is a word of its own, so nothing merges across
            got = np.array(self._encode("\n".join([found[k] for k in solid.tolist()])), np.uint16)
            stop = np.append(np.flatnonzero(got == self.newline), len(got))
            begin[solid] = np.append(0, stop[:-1] + 1) + base
            size[solid] = stop + base - begin[solid]
            parts.append(got)
            base += len(got)
        for k in np.flatnonzero(blank).tolist():
            got = np.array(self._encode(found[k]), np.uint16)
            begin[k], size[k] = base, len(got)
            parts.append(got)
            base += len(got)
        self.ids = np.concatenate(parts)
        new = (hashes, begin.astype(np.uint32), size.astype(np.uint32))
        while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            new = tuple(np.concatenate(x) for x in zip(self.levels.pop(), new))
        order = np.argsort(new[0])
        self.levels.append(tuple(x[order] for x in new))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin (-1 for an unknown word) and how many they are."""
        begin, size = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        open_ = np.arange(len(hashes))
        for known, first, many in self.levels:
            at = np.minimum(np.searchsorted(known, hashes[open_]), len(known) - 1)
            hit = known[at] == hashes[open_]
            begin[open_[hit]], size[open_[hit]] = first[at[hit]], many[at[hit]]
            open_ = open_[~hit]
        return begin, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``END_ID``, and where each begins."""
        text = data.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(offsets) - 1
        if not len(cp):
            return np.full(n, END_ID, np.uint32), np.arange(n + 1)
        start = word_starts(cp, first)
        size = np.diff(np.append(start, len(cp)))
        within = np.arange(len(cp)) - np.repeat(start, size)
        h = np.add.reduceat((cp.astype(np.uint64) * words.U64(0x9E3779B97F4A7C15) + words.U64(0x632BE5AB)) * words.powers(int(size.max()))[within], start)
        h = words.mix(h + size.astype(np.uint64))
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        if sum(len(x[0]) for x in self.levels) > REMEMBERED:
            self.forget()
        missing = np.flatnonzero(self.look_up(distinct)[0] < 0)
        if len(missing):
            begin, stop = start[at[missing]], (start + size)[at[missing]]
            found = [text[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
            self.learn(distinct[missing], found, char_classes()[cp[stop - 1]] == SPACE)
        begin, many = (x[back] for x in self.look_up(distinct))
        owner = np.searchsorted(first, start, "right") - 1
        ids = self.ids[ragged(begin, many)].astype(np.uint32)
        per_text = np.bincount(owner, many, n).astype(np.int64)
        unsure = np.flatnonzero(char_classes()[cp] == UNSURE)
        if len(unsure):
            whole = np.unique(np.searchsorted(first, unsure, "right") - 1)
            lists = np.split(ids, np.cumsum(per_text)[:-1])
            for t in whole.tolist():
                lists[t] = np.array(self._encode(text[first[t] : first[t + 1]]), np.uint32)
            ids, per_text = np.concatenate(lists), np.array([len(x) for x in lists])
        out = np.full(len(ids) + n, END_ID, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), per_text)] = ids
        return out, np.concatenate([[0], np.cumsum(per_text + 1)])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs of ``size`` from ``begin``, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


@functools.lru_cache(maxsize=2)
def tokeniser(path: str) -> Tokeniser:
    return Tokeniser(path)


def cut(first: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts whose ids begin at ``first``: text, number, start and length; only the first may be short."""
    n = np.diff(first)
    per = -(-n // capacity)
    text = np.repeat(np.arange(len(n)), per)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    head = ((n - 1) % capacity + 1)[text]
    start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
    return text, piece, start, np.where(piece == 0, head, capacity)


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenise(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: ids as little-endian unsigned 32-bit numbers, the end id included.

    A null text is an empty one, which is the end id alone.
    """
    path = vocabulary or default_vocabulary()

    def cut_part(coder: Tokeniser, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = words.utf8(part.column("text"))
        for i, j in words.slices(offsets, PART_BYTES):
            ids, first = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text, piece, start, length = cut(first, capacity)
            bounds = np.append(first[text] + start, first[-1]).astype(np.int32) * 4
            body = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids))])
            yield record({"doc_id": part.column("doc_id").take(pa.array(i + text)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids": body}, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()  # what tasks before left
        coder = tokeniser(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, PART_ROWS):
                yield from cut_part(coder, batch.slice(begin, PART_ROWS))
            words.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def patterns(capacity: int) -> list[tuple[int, ...]]:
    """All ways to fill a sequence exactly with two or three lengths, the pairs first."""
    out: list[tuple[int, ...]] = [(a, capacity - a) for a in range(1, capacity // 2 + 1)]
    out += [(a, b, capacity - a - b) for a in range(1, capacity // 3 + 1) for b in range(a, (capacity - a) // 2 + 1)]
    return out


def fit_counts(histogram: np.ndarray, pats: list[tuple[int, ...]], rounds: int = 6, seed: int = 4) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in least squares, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(pats)
    order = np.random.default_rng(seed).permutation(len(pats)).tolist()
    for _ in range(rounds):
        for j in order:
            p = pats[j]
            gain = norm = 0.0
            for v in set(p):
                k = p.count(v)
                gain += k * rest[v]
                norm += k * k
            new = x[j] + gain / norm
            new = new if new > 0 else 0.0
            move = new - x[j]
            if move:
                x[j] = new
                for v in p:
                    rest[v] -= move
    return np.array(x)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, end rank, first sequence, offset) for runs of ranks.

    Rank r of a length goes to sequence ``first sequence + r - first rank``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    pats = [p for p in patterns(capacity) if all(left[v] for v in p)]
    tries = [fill(left.copy(), pats, capacity, share) for share in HELD_BACK]
    groups = min(tries, key=lambda g: sum(n for _, n in g))
    rows, used, sequence = [], [0] * (capacity + 1), 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], used[v] + n, sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    return rows


def fill(left: np.ndarray, pats: list[tuple[int, ...]], capacity: int, held_back: float) -> list[tuple[list[int], int]]:
    """Groups of equal sequences: fitted patterns first, then the pieces they left over.

    ``held_back`` keeps that share of the shortest pieces (falling to none at full length) out of the
    fit, as short ones close the gaps beside leftover long ones.
    """
    groups: list[tuple[list[int], int]] = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    x = fit_counts(left * (1 - held_back * (1 - np.arange(capacity + 1) / capacity)), pats)
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] < 1:
            break
        p = pats[j]
        n = min(int(x[j]), *(int(left[v]) // p.count(v) for v in p))
        if n > 0:
            groups.append((list(p), n))
            for v in p:
                left[v] -= n
    return groups + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: groups of (lengths, how many sequences hold just these)."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            free = next((f for f in range(v, capacity) if open_.get(f)), None)
            if free is None:
                per = capacity // v
                if full := n // per:
                    open_.setdefault(capacity - per * v, []).append(([v] * per, full))
                if rest := n % per:
                    open_.setdefault(capacity - rest * v, []).append(([v] * rest, 1))
                break
            held, m = open_[free].pop()
            take = min(n, m)
            if m > take:
                open_[free].append((held, m - take))
            open_.setdefault(free - v, []).append(([*held, v], take))
            n -= take
    return [g for groups in open_.values() for g in groups]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with ``sequence_id`` and ``offset``.

    Sequences are filled without gaps from 0. An empty table stays empty; equal rows are as many pieces.
    """
    held = cut_lineage(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # at most ``capacity`` rows
    buckets = max(1, math.ceil(sum(histogram.values()) / BUCKET_ROWS))
    keyed = held.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "_bucket", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("_rank", rank).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_bucket", "_before")
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + r, "right") - 1
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["sequence_id"], columns["offset"] = pa.array(rows[at, 3] + r - rows[at, 1]), pa.array(rows[at, 4])
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    names = [*held.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*held.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    return ranked.select(*held.columns, "_rank").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their place; ids appear as their crc32, the ids themselves are :func:`tokenise`'s."""
    pieces = tokenise(docs, vocabulary).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
