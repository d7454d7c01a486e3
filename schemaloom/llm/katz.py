"""Language-model scores by Katz backoff over n-grams of any order.

An n-gram seen r times, r up to K, is discounted by Good-Turing from the counts of counts of its order, taken over the
whole corpus; where they give no ratio between 0 and 1, the ratio is r / (r + 1). Counts above K keep all but one part
in c + 1, where c is the count of the history, so that every history leaves something to the words not seen after it.
Those get the probability of the next lower order, recursively, times the weight that makes each history's distribution
sum to one exactly. The lowest order is the distribution of the base score: counts plus one, with one class for all
unseen words.

Documents are cut into chunks of bounded size, which are written once, as numbers of words. All histories of a word
end in the word before it. So n-grams are dealt to parts by that word, and one shuffle of the distinct n-grams of each
chunk serves all orders: a part sums them, sums the n-grams of lower order out of them, and answers each chunk with
the counts of its n-grams and, where the chunk has a word that training never saw after a history, with the sums that
the history's weight needs. A word that holds more than HOT parts' share of all tokens is dealt by itself and the next
word together; the sums of its histories are then added up over parts and joined with the chunks that ask for them.
The number of parts follows the number of tokens, so a part has the same size at any scale. The driver gets the
number of tokens, of types and of counts of counts, and no other data.

Words are known by a 64-bit hash, then by a number that their part gives them; histories of hot words by a 64-bit hash
of these numbers. Texts: null is empty and is scored by its end alone. A null id is in no fold: it is scored, not
learned from, and not held out. Repeated rows are counted and scored each. Other columns are not read. Without training
tokens every token has the base probability. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .suffix_dedup import BLOBS, BLOBS_SQL, Chunk, _chunks, _eights, _mix, _rows

FOLDS, HELD_OUT = 7, 2
ORDER = 3
K = 5
#: Parts' shares of all tokens beyond which a word is dealt with its successor.
HOT = 4
CHUNK = 10_000_000
#: Tokens of a part.
PART = 700_000
END = np.uint64(0x454E44)
#: Numbers of the begin of a text, and of what lies before it.
START, PAD = 1 << 62, (1 << 62) + 1
#: What stands in the column `part` of rows that aren't an answer: counts of counts, sums of hot histories, and asked hot histories.
COUNTS, SUMS, ASKED = -1, -2, -3
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDTH = 2 * K + 1


def learned(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


# -- small files of numbers ------------------------------------------------------------------------------------------


def _squeeze(a: np.ndarray) -> tuple[int, bytes]:
    """Numbers from zero on, in as few bytes as the greatest needs, all first bytes first: they compress well so."""
    size = next(s for s in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * s))
    return size, a.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _expand(given: tuple[int, bytes]) -> np.ndarray:
    size, data = given
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _pack(data) -> bytes:
    return zstandard.compress(pickle.dumps(data, 5), 3)


def _unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _heads(a: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


# -- chunks ----------------------------------------------------------------------------------------------------------


def _word_hash(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    eights, left, step = _eights(raw), np.arange(len(begin)), 0
    while len(left):
        rest = np.minimum(size[left] - step, 8).astype(np.uint64)
        part = eights[begin[left] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        h[left] = _mix(h[left] ^ part, h[left] + np.uint64(step))
        step += 8
        left = left[size[left] > step]
    return h


def tokens(c: Chunk) -> dict:
    """A chunk as hashes of its distinct words, frequent ones first, and the number of the word of each token."""
    raw = np.frombuffer(c.raw.tobytes().lower() + bytes(8), np.uint8)
    black = np.zeros(len(raw) + 1, bool)
    black[: len(c.raw)] = ~WHITE[raw[: len(c.raw)]]
    inner = black[1:] & black[:-1]
    inner[c.edges[1:-1][c.edges[1:-1] > 0] - 1] = False  # no word crosses documents
    begin = np.flatnonzero(black[:-1] & ~np.r_[False, inner[:-1]])
    end = np.flatnonzero(black[:-1] & ~inner) + 1
    sizes = np.diff(np.searchsorted(begin, c.edges)) + 1
    ends = np.cumsum(sizes) - 1
    found = np.full(int(sizes.sum()), END, np.uint64)
    is_word = np.ones(len(found), bool)
    is_word[ends] = False
    found[is_word] = _word_hash(raw, begin, end - begin)
    keys, token, often = np.unique(found, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    on = np.array([not null and learned(int(i)) for i, null in zip(c.ids, c.null, strict=True)], bool)
    return {"keys": keys[order], "token": _squeeze(place[token]), "sizes": _squeeze(sizes), "on": on, "ids": c.ids, "null": c.null}


class Tokens:
    def __init__(self, blob: bytes) -> None:
        d = _unpack(blob)
        self.keys, self.on, self.ids, self.null = d["keys"], d["on"], d["ids"], d["null"]
        self.token, self.sizes = _expand(d["token"]), _expand(d["sizes"])
        self.edges = np.r_[0, np.cumsum(self.sizes)]
        self.weight = np.repeat(self.on, self.sizes)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


# -- words -----------------------------------------------------------------------------------------------------------


def _send_words(parts: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"], strict=True):
                t = Tokens(blob.as_py())
                counts = np.bincount(t.token, t.weight, len(t.keys)).astype(np.int64)
                order, cuts = _by_part((t.keys % np.uint64(parts)).astype(np.int64), parts)
                rows = [(chunk, p, _pack((t.keys[o], _squeeze(counts[o])))) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
                yield from _rows(BLOBS, rows).to_batches()

    return run


def _total_words(table: pa.Table) -> pa.Table:
    """Totals of words and their numbers in the part, frequent ones first; chunk -1 has the sums of the part."""
    blobs = [_unpack(b) for b in table["blob"].to_pylist()]
    keys, kind = np.unique(np.concatenate([k for k, _ in blobs]), return_inverse=True)
    total = np.bincount(kind, np.concatenate([_expand(c) for _, c in blobs]), len(keys)).astype(np.int64)
    place = np.empty(len(keys), np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(keys))
    answers = np.split(kind, np.cumsum([len(k) for k, _ in blobs])[:-1])
    part = table["part"][0].as_py()
    rows = [(c, part, _pack((_squeeze(total[a]), _squeeze(place[a])))) for c, a in zip(table["chunk"].to_pylist(), answers, strict=True)]
    return _rows(BLOBS, [*rows, (-1, part, f"{total.sum()},{(total > 0).sum()},{total[keys == END].sum()}".encode())])


# -- n-grams ---------------------------------------------------------------------------------------------------------


class Corpus:
    """What the whole corpus says: tokens, types and texts to learn from, and the number of parts."""

    def __init__(self, size: int, types: int, starts: int, parts: int, order: int) -> None:
        self.size, self.types, self.starts, self.parts, self.order = size, types, starts, parts, order

    def hot(self, total: np.ndarray) -> np.ndarray:
        return total * self.parts > HOT * self.size


def _history_key(numbers: list[np.ndarray]) -> np.ndarray:
    """A hash of histories, from the last word backwards."""
    h = np.full(len(numbers[0]), len(numbers), np.uint64)
    for n in numbers:
        h = _mix(h, n.astype(np.uint64))
    return h


class Grams:
    """The distinct n-grams of a chunk, ordered by history from its last word backwards, then by word.

    back[j] is the word j + 1 before the last one; history[k] numbers the histories of order k.
    """

    def __init__(self, t: Tokens, replies: pa.Table, corpus: Corpus) -> None:
        total, number = np.zeros(len(t.keys), np.int64), np.zeros(len(t.keys), np.int64)
        order, cuts = _by_part((t.keys % np.uint64(corpus.parts)).astype(np.int64), corpus.parts)
        for p, blob in zip(replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True):
            own = order[cuts[p] : cuts[p + 1]]
            a, b = _unpack(blob)
            total[own], number[own] = _expand(a), _expand(b) * corpus.parts + p
        rank = np.argsort(number)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.total = np.r_[total[rank], corpus.starts, corpus.starts]
        self.number = np.r_[number[rank], START, PAD]
        self.token = place[t.token]
        n, width = len(rank), len(rank) + 2
        at = np.arange(len(self.token)) - np.repeat(t.edges[:-1], t.sizes)

        def before(j: int) -> np.ndarray:
            out = np.where(at == j - 1, n, n + 1)
            out[j:] = np.where(at[j:] >= j, self.token[:-j], out[j:])
            return out

        code, levels = before(1), []
        for j in range(2, corpus.order):
            found, code = np.unique(code * width + before(j), return_inverse=True)
            levels.append(found)
        found, self.row = np.unique(code * width + self.token, return_inverse=True)
        self.word, history = found % width, found // width
        self.history, self.back = {corpus.order: history}, []
        for k, level in zip(range(corpus.order - 1, 1, -1), reversed(levels), strict=True):
            self.back.insert(0, level[history] % width)
            history = level[history] // width
            self.history[k] = history
        self.back.insert(0, history)
        some = np.empty(len(found), np.int64)
        some[self.row] = np.arange(len(self.row))
        self.previous = np.where(at[some] > 0, self.row[some - 1], -1)
        self.counts = np.bincount(self.row, t.weight, len(found)).astype(np.int64)
        self.hot = corpus.hot(self.total)[self.back[0]]
        last = self.number[self.back[0]].astype(np.uint64)
        part = _mix(last, np.where(self.hot, self.number[self.word], 0).astype(np.uint64))
        self.order, self.cuts = _by_part((part % np.uint64(corpus.parts)).astype(np.int64), corpus.parts)

    def of(self, p: int) -> np.ndarray:
        return self.order[self.cuts[p] : self.cuts[p + 1]]

    def send(self, p: int) -> bytes:
        own = self.of(p)
        columns = [*(b[own] for b in self.back), self.word[own]]
        words, index = np.unique(np.concatenate(columns), return_inverse=True)
        first, *rest = np.split(index, len(columns))
        told = np.zeros(len(words), bool)  # whose total a part needs
        told[rest[-1][self.counts[own] > 0]] = True
        told[first[self.hot[own]]] = True
        return _pack((_squeeze(np.diff(self.number[words], prepend=0)), _squeeze(np.where(told, self.total[words], 0)), _squeeze(np.diff(first, prepend=0)), [_squeeze(c) for c in rest], _squeeze(self.counts[own])))


def _send_grams(corpus: Corpus):
    def run(key: tuple, chunks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        for blob in chunks["blob"]:
            g = Grams(Tokens(blob.as_py()), replies, corpus)
            rows += [(int(key[0].as_py()), p, g.send(p)) for p in range(corpus.parts) if len(g.of(p))]
        return _rows(BLOBS, rows)

    return run


def _unseen(counts: np.ndarray, hot: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without a count after a history that isn't hot, and which of them are the first of their history."""
    rows = np.flatnonzero((counts == 0) & ~hot)
    return rows, _heads(history[rows])


def _total_grams(corpus: Corpus):
    """Counts of all orders for every chunk that asked, and the sums of histories whose weight it needs."""

    def run(table: pa.Table) -> pa.Table:
        chunks, part = table["chunk"].to_pylist(), table["part"][0].as_py()
        blobs = [_unpack(b) for b in table["blob"].to_pylist()]
        numbers = [np.cumsum(_expand(b[0])) for b in blobs]
        number, kind = np.unique(np.concatenate(numbers), return_inverse=True)
        total = np.zeros(len(number), np.int64)
        np.maximum.at(total, kind, np.concatenate([_expand(b[1]) for b in blobs]))
        places = np.split(kind, np.cumsum([len(n) for n in numbers])[:-1])
        back = [np.concatenate([p[np.cumsum(_expand(b[2]))] for p, b in zip(places, blobs, strict=True)])]
        back += [np.concatenate([p[_expand(b[3][j])] for p, b in zip(places, blobs, strict=True)]) for j in range(corpus.order - 1)]
        word = back.pop()
        given = [_expand(b[4]) for b in blobs]
        edges = np.cumsum([len(c) for c in given])[:-1]
        given = np.concatenate(given)
        hot = corpus.hot(total)[back[0]]
        asker = np.repeat(np.arange(len(blobs)), np.diff(np.r_[0, edges, len(word)]))
        width, history = len(number), back[0]
        answers: list[list] = [[] for _ in blobs]
        rows, of_counts, lower = [], [], None
        for k in range(2, corpus.order + 1):
            if k > 2:
                _, history = np.unique(history * width + back[k - 2], return_inverse=True)
            _, gram = np.unique(history * width + word, return_inverse=True)
            counts = np.bincount(gram, given).astype(np.int64)
            some = np.empty(len(counts), np.int64)
            some[gram] = np.arange(len(gram))
            of_counts.append([int((counts == r).sum()) for r in range(1, K + 2)])
            seen = counts > 0
            owner, sums = history[some], np.zeros((WIDTH, int(history.max()) + 1), np.int64)

            def add(where: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
                return np.bincount(owner[where], None if weight is None else weight[where], sums.shape[1]).astype(np.int64)  # noqa: B023

            for r in range(1, K + 1):
                sums[r - 1] = add(counts == r)
            if k == 2:
                sums[K], sums[K + 1] = add(seen, total[word[some]]), add(seen)
            else:
                below = lower[some]
                for r in range(1, K + 1):
                    sums[K + r - 1] = add(seen & (below == r))
                sums[2 * K] = add(seen & (below > K), below)
            lower = counts[gram]
            for i, (c, h, q) in enumerate(zip(np.split(lower, edges), np.split(history, edges), np.split(hot, edges), strict=True)):
                at, heads = _unseen(c, q, h)
                answers[i].append((_squeeze(c), [_squeeze(s) for s in sums[:, h[at[heads]]]]))
            if hot.any():
                some = np.empty(sums.shape[1], np.int64)
                some[history[hot]] = np.flatnonzero(hot)
                held = np.unique(history[hot])
                keys = _history_key([number[b[some[held]]] for b in back[: k - 1]])
                rows.append((-1, SUMS, _pack((keys, sums[:, held]))))
                ask = np.unique(np.stack([asker, history])[:, hot & (lower == 0)], axis=1)
                for i in np.unique(ask[0]).tolist():
                    rows.append((chunks[i], ASKED, _pack(keys[np.searchsorted(held, ask[1][ask[0] == i])])))
        rows += [(chunk, part, _pack(a)) for chunk, a in zip(chunks, answers, strict=True)]
        return _rows(BLOBS, [*rows, (-1, COUNTS, _pack(of_counts))])

    return run


def _long(batches, found):
    for batch in batches:
        for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            yield found(chunk, _unpack(blob))


SUM_NAMES = [f"s{i}" for i in range(WIDTH)]


def _hot_sums(batches):
    def found(_, data):
        return pa.RecordBatch.from_arrays([pa.array(data[0].view(np.int64)), *(pa.array(s) for s in data[1])], names=["key", *SUM_NAMES])

    yield from _long(batches, found)


def _hot_asked(batches):
    def found(chunk, keys):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.view(np.int64))], names=["chunk", "key"])

    yield from _long(batches, found)


def _hot_replies(batches):
    """Rows of one batch for the same chunk travel together."""
    for batch in batches:
        chunk = batch["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        columns = np.stack([batch[c].to_numpy()[order] for c in ("key", *SUM_NAMES)])
        begin = _heads(chunk[order])
        rows = [(int(chunk[order[a]]), SUMS, _pack(columns[:, a:b])) for a, b in zip(begin, [*begin[1:], len(order)], strict=True)]
        yield from _rows(BLOBS, rows).to_batches()


def _count_rows(batches):
    names = ["k", *(f"n{r}" for r in range(1, K + 2))]
    for batch in batches:
        for blob in batch["blob"].to_pylist():
            rows = [[k, *c] for k, c in enumerate(_unpack(blob), 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(K + 2)], names=names)


def discounts(counts: list[int]) -> np.ndarray:
    """d[r] for r = 0 .. K, from the numbers of n-grams seen 1 .. K + 1 times."""
    n = np.r_[0, counts].astype(float)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (K + 1) * n[K + 1] / n[1]
        d = ((r + 1) * n[2:] / n[1:-1] / r - rest) / (1 - rest)
    return np.r_[1.0, np.where((d > 0) & (d < 1), d, r / (r + 1))]


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _values(g: Grams, replies: pa.Table, hot: pa.Table, d: dict[int, np.ndarray], corpus: Corpus) -> np.ndarray:
    """log10 of the probability of the last word of each n-gram of a chunk, order by order."""
    orders, scale, r = range(2, corpus.order + 1), corpus.size + corpus.types + 1, np.arange(1, K + 1)
    answers = [(g.of(p), _unpack(blob)) for p, blob in zip(replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True)]
    told = np.concatenate([_unpack(b) for b in hot["blob"].to_pylist()], axis=1) if len(hot) else np.zeros((WIDTH + 1, 0), np.int64)
    told = told[:, np.argsort(told[0])]
    value = np.log10((g.total[g.word] + 1) / scale)
    below, of_below = None, None
    for k in orders:
        x = np.zeros(len(g.word), np.int64)
        for own, found in answers:
            x[own] = _expand(found[k - 2][0])
        of_history = g.total[g.back[0]] if k == 2 else np.where(g.previous >= 0, below[g.previous], corpus.starts)
        open_ = np.flatnonzero(x == 0)
        s = np.zeros((WIDTH, len(open_)), np.int64)
        for own, found in answers:
            at, heads = _unseen(x[own], g.hot[own], g.history[k][own])
            if len(at):
                which = np.cumsum(np.isin(np.arange(len(at)), heads)) - 1
                s[:, np.searchsorted(open_, own[at])] = np.stack([_expand(f) for f in found[k - 2][1]])[:, which]
        if told.shape[1]:
            at = np.flatnonzero(g.hot[open_])
            keys = _history_key([g.number[b[open_[at]]] for b in g.back[: k - 1]]).view(np.int64)
            place = np.minimum(np.searchsorted(told[0], keys), told.shape[1] - 1)
            same = told[0][place] == keys
            s[:, at[same]] = told[1:, place[same]]
        c = np.maximum(of_history, 1).astype(float)
        known, c_open = (s[:K].T * r), c[open_]
        left = known @ (1 - d[k][1:]) / c_open + (c_open - known.sum(axis=1)) / c_open / (c_open + 1)
        if k == 2:
            lower = (s[K] + s[K + 1]) / scale
        else:
            lower = (s[K : 2 * K].T * r) @ d[k - 1][1:] / of_below[open_] + s[2 * K] / (of_below[open_] + 1)
        backed = np.where(of_history[open_] > 0, np.log10(left / (1 - lower)), 0) + value[open_]
        seen = x > 0
        value[seen] = np.log10(np.where(x[seen] <= K, d[k][np.minimum(x[seen], K)] * x[seen] / c[seen], x[seen] / (c[seen] + 1)))
        value[open_] = backed
        below, of_below = x, c
    return value


def _score(corpus: Corpus, d: dict[int, np.ndarray]):
    def run(key: tuple, chunks: pa.Table, replies: pa.Table) -> pa.Table:
        out, kind = [], replies["part"].to_numpy()
        of_words, of_grams, of_hot = (replies.filter(pa.array(x)) for x in ((kind >= 0) & (kind < corpus.parts), kind >= corpus.parts, kind == SUMS))
        of_grams = of_grams.set_column(1, "part", pa.compute.subtract(of_grams["part"], corpus.parts))
        for blob in chunks["blob"]:
            t = Tokens(blob.as_py())
            g = Grams(t, of_words, corpus)
            value = _values(g, of_grams, of_hot, d, corpus)
            lower = np.log10((g.total + 1) / (corpus.size + corpus.types + 1))
            scores, base, known = (np.add.reduceat(x, t.edges[:-1]) for x in (value[g.row], lower[g.token], (g.total > 0)[g.token].astype(np.int64)))
            columns = [pa.array(t.ids, pa.int64(), mask=t.null), pa.array(~t.on & ~t.null), pa.array(t.sizes), pa.array(known), pa.array(np.full(len(t.ids), corpus.size)), pa.array(base), pa.array(scores)]
            out.append(pa.Table.from_arrays(columns, schema=RESULT))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    return run


def score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: by n-grams of up to `order` words.

    chunk: bytes of text that are read together. part: tokens that are counted together, about.
    """
    if order < 2:
        raise ValueError("backoff needs word pairs at least")

    def store(batches):
        for n, c in _chunks(batches, chunk):
            t = tokens(c)
            yield from _rows(STORED, [(n, len(t["token"][1]) // t["token"][0], _pack(t))]).to_batches()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunks = stored(rows.mapInArrow(store, "chunk bigint, tokens bigint, blob binary"))
    parts = max(partitions(docs), -(-(chunks.agg(F.sum("tokens")).first()[0] or 0) // part))
    chunks = chunks.select("chunk", "blob")
    words = stored(chunks.mapInArrow(_send_words(parts), BLOBS_SQL).groupBy("part").applyInArrow(_total_words, BLOBS_SQL))
    cut = F.split(F.decode("blob", "UTF-8"), ",")
    sums = words.filter("chunk = -1").select(*(cut[i].cast("bigint").alias(f"x{i}") for i in range(3))).agg(*(F.sum(f"x{i}") for i in range(3))).first()
    corpus = Corpus(*(int(x or 0) for x in sums), parts, order)
    words = words.filter("chunk >= 0")
    sent = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_send_grams(corpus), BLOBS_SQL)
    found = stored(sent.groupBy("part").applyInArrow(_total_grams(corpus), BLOBS_SQL))
    names = [f"n{r}" for r in range(1, K + 2)]
    rows = found.filter(F.col("part") == COUNTS).mapInArrow(_count_rows, "k bigint, " + ", ".join(f"{n} bigint" for n in names))
    of_counts = {r[0]: r[1:] for r in rows.groupBy("k").agg(*(F.sum(n) for n in names)).collect()}
    d = {k: discounts(list(of_counts.get(k, [0] * (K + 1)))) for k in range(2, order + 1)}
    hot = found.filter(F.col("part") == SUMS).mapInArrow(_hot_sums, "key bigint, " + ", ".join(f"{n} bigint" for n in SUM_NAMES))
    hot = hot.groupBy("key").agg(*(F.sum(n).alias(n) for n in SUM_NAMES))
    asked = found.filter(F.col("part") == ASKED).mapInArrow(_hot_asked, "chunk bigint, key bigint").distinct()
    told = asked.join(hot, "key").select("chunk", "key", *SUM_NAMES).mapInArrow(_hot_replies, BLOBS_SQL)
    replies = words.union(found.filter("part >= 0").select("chunk", (F.col("part") + parts).alias("part"), "blob")).union(told)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(corpus, d), RESULT_SQL)


STORED = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("blob", pa.binary())])


def brute_force(rows: list[tuple[int | None, str | None]], order: int = ORDER) -> dict:
    """Scores by the definition, with dictionaries: for tests. Keys are numbers of rows."""
    texts = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    train = [t for t, (d, _) in zip(texts, rows, strict=True) if learned(d)]
    word = Counter(w for t in train for w in t)
    n, v = sum(word.values()), len(word)
    grams: dict[int, Counter] = {}

    def history(t, i, k):
        return tuple((["pad"] * k + ["start"] + t[:i])[-(k - 1) :])

    for k in range(2, order + 1):
        grams[k] = Counter((history(t, i, k), t[i]) for t in train for i in range(len(t)))
    after: dict[tuple, dict] = {}
    for k in grams:
        for (h, w), c in grams[k].items():
            after.setdefault(h, {})[w] = c
    ratio = {}
    for k in grams:
        seen = Counter(grams[k].values())
        for r in range(1, K + 1):
            ratio[k, r] = r / (r + 1)
            if seen[1] and seen[r] and (K + 1) * seen[K + 1] != seen[1]:
                over = (K + 1) * seen[K + 1] / seen[1]
                good = ((r + 1) * seen[r + 1] / seen[r] / r - over) / (1 - over)
                if 0 < good < 1:
                    ratio[k, r] = good

    def probability(h, w):
        if not h:
            return (word[w] + 1) / (n + v + 1)
        if h not in after:
            return probability(h[1:], w)
        c = sum(after[h].values())
        share = lambda x: ratio[len(h) + 1, x] * x / c if x <= K else x / (c + 1)
        if w in after[h]:
            return share(after[h][w])
        left = 1 - sum(map(share, after[h].values()))
        return left / (1 - sum(probability(h[1:], x) for x in after[h])) * probability(h[1:], w)

    scores = [
        (len(t), sum(word[w] > 0 for w in t), n, sum(math.log10((word[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(probability(history(t, i, order), t[i])) for i in range(len(t))))
        for t in texts
    ]
    return {"scores": scores, "probability": probability, "words": [*word], "histories": [*after]}
