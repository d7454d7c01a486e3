"""Exact repeated passages by a depth-limited radix sort of suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a smaller id.
Suffixes need an order only through `length` bytes, and only those that share their first digits with another
document need one at all. So the sort goes by digits, the most significant first, and stops wherever a group holds
no second document:

1. The first digit of a suffix is the least hashed 16-gram in its window of `length` bytes. Equal windows have equal
   first digits, and neighbouring suffixes mostly share one, so a run of about 18 suffixes is dealt out as one key of
   6 bytes. Keys that occur in one document only end here; the answer to a chunk of documents is one bit a key.
2. Runs whose first digit is shared are sent as their bytes, equal runs of a chunk once. In each partition equal runs
   are merged, and where a digit has different runs, their suffixes are ordered by digits of 8 bytes, group by group,
   until `length` bytes are reached. Groups that are left are exactly the repeated windows; each knows its least id.

A run that repeats inside a chunk of documents is sent for the least id only, for the others are covered by it. So
a passage of a third of all documents costs a row a chunk, not a row a document, and no pairs are made. Chunks hold
a few megabytes, or one document if that is longer, and are written once, so that a task that is run again finds the
same ones. The number of parts follows the bytes of all texts, so a part has the same size at any scale.

Texts: null is empty. A null id counts as greater than all others, and as equal to other nulls. Rows that repeat an
id take nothing from each other. Documents under `length` bytes stay whole. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

LENGTH = 50
GRAM = 16
CHUNK = 4_000_000
PART = 8_000_000
BLOCK = 1 << 16
LAST_ID = np.iinfo(np.int64).max
# Odd multipliers that spread bits.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _pack(data) -> bytes:
    return zstandard.compress(pickle.dumps(data, 5), 1)


def _unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; a view."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * M1
    h ^= (b * M2) >> np.uint64(7)
    h ^= h >> np.uint64(31)
    h *= M3
    h ^= h >> np.uint64(29)
    return h * M1


@dataclass
class Runs:
    """Runs of neighbouring suffixes with the same first digit, in the order of the text."""

    begin: np.ndarray  # first suffix
    count: np.ndarray  # suffixes
    key: np.ndarray  # first digit, 48 bits
    digit_at: np.ndarray  # where the 16-gram is, from begin
    doc: np.ndarray  # number of the document in the chunk


def runs(raw: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> Runs:
    """raw: the bytes of documents one after the other; document i is raw[edges[i] : edges[i + 1]]."""
    n = max(0, len(raw) - length + 1)
    least = np.empty(n, np.uint32)  # where the least gram of each window is
    eights, span = _eights(raw), length - GRAM + 1
    high = np.uint64(0xFFFFFFFF00000000)
    for lo in range(0, n, BLOCK):
        windows = min(BLOCK, n - lo)
        grams = windows + span - 1
        h = _mix(eights[lo : lo + grams], eights[lo + 8 : lo + 8 + grams])
        h &= high
        h |= np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: windows], h[span - width : span - width + windows])
        least[lo : lo + windows] = (h[:windows] & np.uint64(0xFFFFFFFF)).astype(np.uint32) + np.uint32(lo)
    change = np.ones(n, bool)
    change[1:] = least[1:] != least[:-1]
    ends = edges[1:] - length + 1  # first place of a document where no window begins
    long = ends > edges[:-1]
    change[edges[:-1][long]] = True
    cut = ends[long]
    change[cut[cut < n]] = True
    begin = np.flatnonzero(change)
    count = np.diff(np.r_[begin, n])
    doc = np.searchsorted(edges, begin, "right") - 1
    good = begin < ends[doc] if len(begin) else np.zeros(0, bool)
    begin, count, doc = begin[good], count[good], doc[good]
    at = least[begin].astype(np.int64)
    key = _mix(eights[at], eights[at + 8]) >> np.uint64(16)
    return Runs(begin, count, key, at - begin, doc)


@dataclass
class Chunk:
    ids: np.ndarray  # of the documents, ascending; null is LAST_ID
    null: np.ndarray
    edges: np.ndarray
    raw: np.ndarray


def _chunks(batches, size: int):
    """Documents in the order of their ids, chunk by chunk."""
    base = TaskContext.get().partitionId() << 32
    held, total, n = [], 0, 0

    def close():
        order = sorted(range(len(held)), key=lambda i: (held[i][0] is None, held[i][0] or 0))
        ids = np.array([LAST_ID if held[i][0] is None else held[i][0] for i in order], np.int64)
        null = np.array([held[i][0] is None for i in order], bool)
        edges = np.r_[0, np.cumsum([len(held[i][1]) for i in order])].astype(np.int64)
        raw = np.frombuffer(b"".join(held[i][1] for i in order) + bytes(8), np.uint8)[:-8]
        return base + n, Chunk(ids, null, edges, raw)

    for batch in batches:
        for key, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            held.append((key, (value.as_py() or "").encode()))
            total += len(held[-1][1])
            if total >= size:
                yield close()
                held, total, n = [], 0, n + 1
    if held:
        yield close()


def _parts(key: np.ndarray, parts: int) -> np.ndarray:
    return (key % np.uint64(parts)).astype(np.int64)


def _digits(r: Runs, parts: int):
    """The distinct first digits of a chunk, ordered by part and digit, and whether two documents have them."""
    order = np.lexsort((r.doc, r.key))
    key, doc = r.key[order], r.doc[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(key)] - 1
    key, many = key[first], doc[first] != doc[last] if len(key) else np.zeros(0, bool)
    part = _parts(key, parts)
    order = np.argsort(part, kind="stable")
    return key[order], many[order], np.searchsorted(part[order], np.arange(parts + 1))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _long(batches):
    for batch in batches:
        for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"], strict=True):
            yield chunk, blob.as_py()


BLOBS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])
BLOBS_SQL = "chunk bigint, part bigint, blob binary"


def _send_digits(parts: int, length: int):
    def run(batches):
        for chunk, blob in _long(batches):
            c = Chunk(**_unpack(blob))
            key, many, cuts = _digits(runs(c.raw, c.edges, length), parts)
            six = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows = []
            for p in range(parts):
                a, b = int(cuts[p]), int(cuts[p + 1])
                if a < b:
                    rows.append((chunk, p, np.packbits(many[a:b]).tobytes() + six[a:b].tobytes()))
            yield from _rows(BLOBS, rows).to_batches()

    return run


def _shared_digits(table: pa.Table) -> pa.Table:
    """For each chunk, which of its first digits another document has, as bits."""
    keys, flags, sizes = [], [], []
    for blob in table["blob"].to_pylist():
        n = len(blob) * 8 // 49  # n digits take n / 8 bytes, rounded up, and 6 n bytes
        while -(-n // 8) + 6 * n < len(blob):
            n += 1
        while -(-n // 8) + 6 * n > len(blob):
            n -= 1
        bits = -(-n // 8)
        eight = np.zeros((n, 8), np.uint8)
        eight[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, bits).reshape(-1, 6)
        keys.append(eight.view("<u8").ravel())
        flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, bits), count=n))
        sizes.append(n)
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = (counts > 1) | (np.bincount(inverse, np.concatenate(flags), len(counts)) > 0)
    answers = np.split(shared[inverse], np.cumsum(sizes)[:-1])
    return pa.Table.from_arrays([table["chunk"], table["part"], pa.array([np.packbits(a).tobytes() for a in answers], pa.binary())], schema=BLOBS)


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[begin[i] : begin[i] + size[i]] one after the other."""
    ends = np.cumsum(size)
    return raw[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _content_hash(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch, from its eights at steps of 8 and its last eight. Stretches hold eight bytes at least."""
    eights = _eights(raw)
    h = size.astype(np.uint64) * M2
    for step in range(0, int(size.max(initial=0)), 8):
        at = begin + np.minimum(step, size - 8)
        h = _mix(h ^ eights[at], h + np.uint64(step))
    return h


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (begin, end) that cover the same, ordered and apart."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.r_[first[1:], len(spans)] - 1]], axis=1)


def _send_runs(parts: int, length: int):
    """Runs with shared first digits, by part; part -1 - chunk holds what the chunk covers by itself."""

    def run(key: tuple, chunks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for k in range(len(chunks)):
            c = Chunk(**_unpack(chunks["blob"][k].as_py()))
            chunk = int(key[0].as_py())
            r = runs(c.raw, c.edges, length)
            digits, _, cuts = _digits(r, parts)
            shared = np.zeros(len(digits), bool)
            for p, blob in zip(replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True):
                a, b = cuts[p], cuts[p + 1]
                shared[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(b - a))
            digits = np.sort(digits[shared])
            at = np.searchsorted(digits, r.key)
            some = np.flatnonzero((at < len(digits)) & (digits[np.minimum(at, len(digits) - 1)] == r.key)) if len(digits) else np.zeros(0, np.int64)
            begin, count, digit, doc, first_digit = r.begin[some], r.count[some], r.digit_at[some], r.doc[some], r.key[some]
            if not len(some):
                continue
            size = count + length - 1
            _, head, kind = np.unique(_content_hash(c.raw, begin, size), return_index=True, return_inverse=True)
            least = head[kind]  # the first run with the same bytes: of the least id, as documents are ordered
            same = size == size[least]
            other = np.flatnonzero(same & (least != np.arange(len(least))))
            step = 1 << 18
            for i in range(0, len(other), step):  # equal hashes are compared byte by byte
                o = other[i : i + step]
                equal = _gather(c.raw, begin[o], size[o]) == _gather(c.raw, begin[least[o]], size[o])
                same[o] = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(size[o])[:-1]])
            least = np.where(same, least, np.arange(len(least)))
            covered = c.ids[doc] > c.ids[doc[least]]
            rows.append((chunk, -1 - chunk, _pack(_merged(np.stack([begin, begin + size], axis=1)[covered]))))
            ask = np.flatnonzero(~covered)
            part = _parts(first_digit[ask], parts)
            order = np.argsort(part, kind="stable")
            ask, edge = ask[order], np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                own = ask[edge[p] : edge[p + 1]]
                heads, entry = np.unique(least[own], return_inverse=True)
                rows.append(
                    (chunk, p, _pack({
                        "bytes": _gather(c.raw, begin[heads], size[heads]), "count": count[heads].astype(np.uint8), "digit": digit[heads].astype(np.uint8),
                        "id": c.ids[doc[heads]], "entry": entry.astype(np.uint32), "place": begin[own].astype(np.uint32),
                    }))
                )
        return _rows(BLOBS, rows)

    return run


def _order(group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the order by group and digit, and the new groups in that order."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    return order, np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (d[1:] != d[:-1])])


def _lasting(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Members of groups, given in order, that hold two ids."""
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    two = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    return np.repeat(two, np.diff(np.r_[heads, len(group)]))


def least_ids(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, digit: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every suffix of every run, the least id of a run that has the same first `length` bytes.

    Runs are distinct. Suffixes are ordered digit by digit; a group of one id is done.
    """
    total = int(count.sum())
    starts = np.cumsum(count) - count
    out = np.repeat(ids, count)
    eights = _eights(raw)
    at = begin + digit
    first = _mix(eights[at], eights[at + 8])
    heads, members = np.unique(first, return_inverse=True)
    several = np.bincount(members, minlength=len(heads))[members] > 1
    rows = np.flatnonzero(several)
    if not len(rows):
        return out
    n = count[rows]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(begin[rows], n) + inner
    slot = np.repeat(starts[rows], n) + inner
    owner = np.repeat(ids[rows], n)
    # Of equal windows the first digit stands at the same place.
    group = np.repeat(members[rows], n) * np.int64(256) + (np.repeat(digit[rows], n) - inner)
    depth = [*range(0, length - 7, 8)]
    if depth[-1] + 8 < length:
        depth.append(length - 8)
    order = np.argsort(group, kind="stable")
    group, place, slot, owner = group[order], place[order], slot[order], owner[order]
    for d in [None, *depth]:
        if d is not None:
            order, group = _order(group, eights[place + d])
            place, slot, owner = place[order], slot[order], owner[order]
        if not len(group):
            break
        stay = _lasting(group, owner)
        group, place, slot, owner = group[stay], place[stay], slot[stay], owner[stay]
        if not len(group):
            break
    if len(group):
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[slot] = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.r_[heads, len(group)]))
    assert len(out) == total
    return out


def _match(length: int):
    """Spans of each chunk that a smaller id covers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks, part = table["chunk"].to_pylist(), int(key[0].as_py())
        if part < 0:
            return table.select(BLOBS.names).cast(BLOBS)
        blobs = [_unpack(b) for b in table["blob"].to_pylist()]
        whole = {k: np.concatenate([b[k] for b in blobs]) for k in ("bytes", "count", "digit", "id")}
        raw, count = np.r_[whole["bytes"], np.zeros(8, np.uint8)], whole["count"].astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        # Equal runs of several chunks are one, with the least id. Equal hashes are compared byte by byte.
        hashed = _content_hash(raw, begin, size)
        _, head, kind = np.unique(hashed, return_index=True, return_inverse=True)
        same = size == size[head[kind]]
        other = np.flatnonzero(same & (head[kind] != np.arange(len(kind))))
        for i in range(0, len(other), 1 << 18):
            o = other[i : i + (1 << 18)]
            equal = _gather(raw, begin[o], size[o]) == _gather(raw, begin[head[kind[o]]], size[o])
            same[o] = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(size[o])[:-1]])
        apart = np.flatnonzero(~same)
        kind = kind.copy()
        kind[apart] = len(head) + np.arange(len(apart))
        head = np.r_[head, apart]
        ids = np.full(len(head), LAST_ID)
        np.minimum.at(ids, kind, whole["id"])
        least = least_ids(raw, begin[head], count[head], whole["digit"].astype(np.int64)[head], ids, length)
        starts = np.cumsum(count[head]) - count[head]
        rows, base = [], 0
        for chunk, b in zip(chunks, blobs, strict=True):
            entry = b["entry"].astype(np.int64) + base
            base += len(b["id"])
            n = count[entry]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = least[np.repeat(starts[kind[entry]], n) + inner] < np.repeat(whole["id"][entry], n)
            place = (np.repeat(b["place"].astype(np.int64), n) + inner)[hit]
            if len(place):
                rows.append((chunk, part, _pack(_merged(np.stack([place, place + length], axis=1)).astype(np.uint32))))
        return _rows(BLOBS, rows)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept binary"


def _apply(key: tuple, chunks: pa.Table, spans: pa.Table) -> pa.Table:
    out = []
    for k in range(len(chunks)):
        c = Chunk(**_unpack(chunks["blob"][k].as_py()))
        gone = np.zeros(len(c.raw) + 1, np.int32)
        for blob in spans["blob"].to_pylist():
            s = _unpack(blob).astype(np.int64)
            np.add.at(gone, s[:, 0], 1)
            np.add.at(gone, s[:, 1], -1)
        mask = np.cumsum(gone[:-1]) > 0
        for i in range(len(c.ids)):
            a, b = int(c.edges[i]), int(c.edges[i + 1])
            m = mask[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
            kept = c.raw[a:b][~m].tobytes()
            out.append((None if c.null[i] else int(c.ids[i]), b - a, int(m.sum()), len(edges) // 2, edges.tolist(), kept))
    return _rows(RESULT, out)


def dedup_passages(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin and end of each removed run, flat) and the bytes kept.

    chunk: bytes of text that are read together. part: bytes of text whose digits are dealt to one part, about.
    """
    if length < GRAM + 8:
        raise ValueError("too short for the first digit")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def store(batches):
        for n, c in _chunks(batches, chunk):
            yield from _rows(STORED, [(n, len(c.raw), _pack(c.__dict__))]).to_batches()

    chunks = stored(rows.mapInArrow(store, "chunk bigint, bytes bigint, blob binary"))
    parts = max(partitions(docs), -(-(chunks.agg(F.sum("bytes")).first()[0] or 0) // part))
    chunks = chunks.select("chunk", "blob")
    digits = chunks.mapInArrow(_send_digits(parts, length), BLOBS_SQL)
    replies = digits.groupBy("part").applyInArrow(_shared_digits, BLOBS_SQL)
    sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_send_runs(parts, length), BLOBS_SQL)
    spans = stored(sent.groupBy("part").applyInArrow(_match(length), BLOBS_SQL))
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_apply, RESULT_SQL)


STORED = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("blob", pa.binary())])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same digests, straight from the definition: for tests."""
    raw = [(LAST_ID if d is None else d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, LAST_ID))
    out = []
    for (d, _), (rank, b) in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < rank:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
