"""Hierarchical packing of documents into context windows of several lengths.

A document is its token ids and an end id. What is longer than the longest window is cut into full windows; the
rest is routed to the shortest tier that holds it. Tiers are packed from the longest: a window begins with a piece
of its own tier, its gap is filled with the longest pieces of shorter tiers that fit, and what is still open is
filled by cutting one piece. So windows are full; only the last tokens of a task, fewer than the longest window,
become windows whose lengths are powers of two. Windows are dealt to step groups of nearly equal attention cost.

The pass is narrow: each task packs the documents that it reads, in chunks of bounded size, and nothing is
shuffled, so a hot source or a very long text moves no data and loses none. A task that is run again reads the same
rows in the same order and gives the same windows; ids of windows hold the number of the partition.

A null text is empty: its document is the end id alone. A null id is kept. Repeated rows are packed each. Other
columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (512, 1024, 2048, 4096)
END = 2
CHUNK_CHARS = 3_000_000
STEP_TOKENS = 65_536
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Packer:
    """Pieces of one task. A piece is (length, number of its document, start)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.free: list[tuple[int, int, int]] = []
        self.held = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            insort(self.free, (length, doc, start))
            self.held += length

    def _take(self, i: int, n: int) -> tuple[int, int, int]:
        """The first n tokens of piece i; the rest goes to the tier of its own length."""
        length, doc, start = self.free.pop(i)
        self.held -= length
        self.add(doc, start + n, length - n)
        return (n, doc, start)

    def windows(self):
        """Yield (tier, pieces) for every window that can be filled."""
        for tier, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0), strict=True):
            while self.free and self.free[-1][0] > below and self.held >= tier:
                yield tier, self._fill(tier)
        while self.held >= self.tiers[-1]:
            yield self.tiers[-1], self._fill(self.tiers[-1])

    def _fill(self, size: int) -> list[tuple[int, int, int]]:
        out, gap = [], size
        while gap:
            i = bisect_right(self.free, (gap, 1 << 62, 0)) - 1  # the longest that fits
            if i < 0:
                i = bisect_left(self.free, (gap + 1, -1, -1))  # else the shortest that doesn't
            out.append(self._take(i, min(gap, self.free[i][0])))
            gap -= out[-1][0]
        return out

    def rest(self):
        """Yield the remaining tokens as windows of falling powers of two."""
        while self.held:
            size = 1 << self.held.bit_length() - 1
            yield size, self._fill(size)


def _groups(windows: list[tuple[int, list]], tokens: int) -> list[int]:
    """Number of the step group of each window: the costliest first, to the group of the least cost so far."""
    count = max(1, -(-sum(size for size, _ in windows) // tokens))
    heap = [(0, g) for g in range(count)]
    out = [0] * len(windows)
    cost = [sum(n * n for n, _, _ in pieces) + 1024 * size for size, pieces in windows]
    for w in sorted(range(len(windows)), key=lambda w: (-cost[w], w)):
        total, g = heap[0]
        heapq.heapreplace(heap, (total + cost[w], g))
        out[w] = g
    return out


def pack(
    docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end: int = END, step_tokens: int = STEP_TOKENS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: where it is in its document and in its window, and its ids as little-endian unsigned 32-bit.

    tokenizer: path of a vocabulary file of the form that `bpe` reads, the same on all executors.
    """

    def run(batches):
        from .bpe import load

        model, packer = load(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        docs_held: dict[int, tuple[int | None, np.ndarray]] = {}
        n_docs = n_windows = n_groups = 0

        def emit(found):
            nonlocal n_windows, n_groups
            if not found:
                return
            groups = _groups(found, step_tokens)
            rows = []
            for (size, pieces), g in zip(found, groups, strict=True):
                at = 0
                for n, d, start in pieces:
                    key, ids = docs_held[d]
                    rows.append((key, start, n, ids[start : start + n].tobytes(), len(ids), base + n_windows, at, size, base + n_groups + g))
                    at += n
                n_windows += 1
            n_groups += max(groups) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        def flush(keys, texts):
            nonlocal n_docs
            flat, sizes = model.encode(texts)
            for key, ids in zip(keys, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                ids = np.append(ids, end).astype("<u4")
                docs_held[n_docs] = (key, ids)
                long = len(ids) // packer.tiers[-1] * packer.tiers[-1]
                yield from ((packer.tiers[-1], [(packer.tiers[-1], n_docs, s)]) for s in range(0, long, packer.tiers[-1]))
                packer.add(n_docs, long, len(ids) - long)
                n_docs += 1
            yield from packer.windows()

        keys, texts, chars = [], [], 0
        for batch in batches:
            for key, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                keys.append(key)
                texts.append(value.as_py() or "")
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    yield from emit(list(flush(keys, texts)))
                    live = {d for _, d, _ in packer.free}
                    docs_held = {d: v for d, v in docs_held.items() if d in live}
                    keys, texts, chars = [], [], 0
        if texts:
            yield from emit(list(flush(keys, texts)))
        yield from emit(list(packer.rest()))

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
