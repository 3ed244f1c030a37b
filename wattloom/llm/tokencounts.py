"""Token counts of whole texts by a two-tier lookup of pre-token lengths, all on the map side.

The vocabulary never merges across the start of a run of blanks: every piece has its blanks in front or is
nothing but blanks. A text is therefore a row of pre-tokens, each a run of blanks with what follows up to
the next blank, and its count is the sum of theirs. The library puts one blank before every text, which
here is the first blank of the first pre-token.

Tier one is a compact table (hash, length) of pre-tokens that are frequent over all texts, the same in every
task; tier two is what a worker has met so far, forgotten as a whole when it grows beyond its bound. What is
in neither is encoded by the vocabulary's own library. No pre-token is shuffled: to find the frequent ones,
a task sends one summary of bounded size, and summaries merge in two steps.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import words
from wattloom.llm.common import record

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: Entries of the frequent table, and of the summary that a task keeps of what it read.
FREQUENT, SUMMARY = 1 << 15, 1 << 14
#: Pre-tokens a worker remembers before it starts anew, and how many bytes are encoded in one call.
REMEMBERED, CALL_BYTES = 1 << 21, 1 << 20
#: Groups of summaries that are merged side by side before the last step.
MERGERS = 256
#: The vocabulary's sign for a blank; in a text it counts as one.
BLANK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pretokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last text, bytes, starts, hashes, first pre-token of each text) by slices; empty texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = words.utf8(pc.replace_substring(texts.cast(pa.large_string()), BLANK, " "))
    for i, j in words.slices(offsets):
        first = offsets[i : j + 1] - offsets[i]
        full = np.flatnonzero(np.diff(first) > 0)
        own = np.insert(data[offsets[i] : offsets[j]], first[full], 32)
        begin = first[full] + np.arange(len(full))
        blank = own == 32
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[begin] = True
        start = np.flatnonzero(head)
        bounds = np.zeros(j - i + 1, np.int64)
        bounds[full + 1] = np.diff(np.append(np.searchsorted(start, begin), len(start)))
        yield i, j, own, start, words.hash_spans(own, start, np.append(start[1:], len(own))), np.cumsum(bounds)


class Counter:
    """Lengths of pre-tokens in tokens, by the library at ``path``, each remembered by its hash."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lone = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.forget()

    def forget(self) -> None:
        #: Runs of (sorted hash, length); later runs are shorter.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def encode(self, found: list[bytes]) -> np.ndarray:
        """Lengths of pre-tokens given with their blanks."""
        out = np.zeros(len(found), np.int64)
        at, size = 0, np.cumsum([len(x) for x in found])
        while at < len(found):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CALL_BYTES, "right")))
            ids = self.library.encode([x[1:].decode() for x in found[at:to]], num_threads=1)
            out[at:to] = [len(x) for x in ids]
            at = to
        out[[k for k, x in enumerate(found) if len(x) == 1]] = self.lone  # a blank at the end of a text
        return out

    def learn(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        new = (hashes, lengths)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            new = tuple(np.concatenate(x) for x in zip(self.levels.pop(), new))
        order = np.argsort(new[0])
        self.levels.append((new[0][order], new[1][order]))

    def lengths(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Lengths of distinct pre-tokens: the table first, then what is remembered, then the library."""
        out = np.zeros(len(hashes), np.int64)
        open_ = np.arange(len(hashes))
        for known, length in (table, *self.levels):
            if len(known) and len(open_):
                at = np.minimum(np.searchsorted(known, hashes[open_]), len(known) - 1)
                hit = known[at] == hashes[open_]
                out[open_[hit]] = length[at[hit]]
                open_ = open_[~hit]
        if len(open_):
            out[open_] = self.encode(spans(data, start[open_], end[open_]))
            if sum(len(x[0]) for x in self.levels) > REMEMBERED:
                self.forget()
            self.learn(hashes[open_], out[open_])
        return out


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    body = data.tobytes()
    return [body[a:b] for a, b in zip(start.tolist(), end.tolist())]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def top(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Indices of the ``size`` largest counts in order of hash, ties to the smaller hash."""
    keep = np.lexsort((hashes, -counts))[:size]
    return keep[np.argsort(hashes[keep])]


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One summary (hash, count, length) of several, cut to ``size`` entries."""
    hashes, counts, lengths = (np.concatenate(x) for x in zip(*parts))
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(back, counts, len(distinct)).astype(np.int64)
    keep = top(distinct, total, size)
    return distinct[keep], total[keep], lengths[at[keep]]


SUMMED = "part int, hashes binary, counts binary, lengths binary"


def _packed(part: int, summary: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    hashes, counts, lengths = summary
    return record({"part": [part], "hashes": [hashes.tobytes()], "counts": [counts.tobytes()], "lengths": [lengths.tobytes()]}, SUMMED)


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
    return read("hashes", np.uint64), read("counts", np.int64), read("lengths", np.int64)


def summaries(docs: DataFrame, path: str, size: int = SUMMARY) -> DataFrame:
    """One row per task: its most frequent pre-tokens as (hash, count, length) arrays of at most ``size`` entries.

    A pre-token is counted from when it entered the summary, so counts are lower bounds; what they decide
    is only which lengths are looked up first, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        texts: dict[int, bytes] = {}
        for batch in batches:
            for _, _, own, start, h, _ in pretokens(batch.column("text")):
                if not len(h):
                    continue
                distinct, at, n = np.unique(h, return_index=True, return_counts=True)
                both, back = np.unique(np.concatenate([known, distinct]), return_inverse=True)
                total = np.bincount(back, np.concatenate([counts, n]), len(both)).astype(np.int64)
                keep = top(both, total, size)
                gone = np.setdiff1d(known, both[keep], assume_unique=True)
                new = np.setdiff1d(both[keep], known, assume_unique=True)
                for x in gone.tolist():
                    del texts[x]
                where = at[np.searchsorted(distinct, new)]
                texts.update(zip(new.tolist(), spans(own, start[where], np.append(start[1:], len(own))[where])))
                known, counts = both[keep], total[keep]
        if len(known):
            yield _packed(0, (known, counts, counter(path).encode([texts[x] for x in known.tolist()])))

    return docs.select("text").mapInArrow(run, SUMMED)


def frequent(docs: DataFrame, path: str, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, lengths) of the pre-tokens that are frequent over all of ``docs``: at most ``size``, 10 bytes each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = _unpacked(batch, row)
                held = merged([held, one] if held else [one], size)
        if held:
            yield _packed(0, held)

    parts = summaries(docs, path).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    some = parts.groupBy("part").applyInArrow(merge, SUMMED)
    last = some.groupBy("part").applyInArrow(merge, SUMMED).toArrow()  # one row of bounded size
    if not last.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int16)
    hashes, _, lengths = _unpacked(last.combine_chunks().to_batches()[0], 0)
    fits = lengths < 1 << 15
    return hashes[fits], lengths[fits].astype(np.int16)


COUNTED = "doc_id long, n_bytes long, n_tokens long"


def count(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``n_tokens`` is the number of pieces that the library gives for the whole text, without added ones;
    ``over_limit`` says whether it exceeds ``limit``. A null text is an empty one and has no tokens. Rows
    without id, and repeated rows, are counted like others; other columns are ignored. ``vocabulary`` is a
    sentencepiece file without blanks inside its pieces, readable at the same path by every executor.

    Pre-tokens are told apart by 64-bit hashes.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = frequent(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            texts = batch.column("text")
            total = np.zeros(batch.num_rows, np.int64)
            for i, j, own, start, h, first in pretokens(texts):
                if len(h):
                    distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
                    end = np.append(start[1:], len(own))
                    lengths = known.lengths(distinct, own, start[at], end[at], table)
                    before = np.concatenate([[0], np.cumsum(lengths[back])])
                    total[i:j] = before[first[1:]] - before[first[:-1]]
            n_bytes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0)
            yield record({"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": total}, COUNTED)

    return rows.mapInArrow(run, COUNTED).withColumn("over_limit", F.col("n_tokens") > limit)
