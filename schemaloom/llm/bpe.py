"""A word BPE vocabulary file, applied to many texts at once with numpy.

Ids equal those of the tokenizers library for the same file, which the tests check. The library is slow on many
short texts, so a chunk of texts is classified, cut into pre-tokens and reduced to its distinct pre-tokens with
array operations; only those run through the merges, all of them side by side. Nothing is trained or cached
between chunks, so memory is bounded by the chunk.

The file must hold a BPE model with an end-of-word suffix over byte symbols, and the normaliser and pre-tokeniser
that `check_form` names; any other file is refused. Pre-tokens are grouped by a 64-bit hash and then compared byte by byte.
Added tokens are taken out of a text before anything else, as the library does.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import numpy as np

#: The contractions that the vocabulary's pattern takes whole, longest first where they clash.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Longer pre-tokens go through the library, one by one.
LONG = 512
PATTERN = "|".join(CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point: white space, letter, digit or other."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    # White_Space of Unicode.
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself where it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


@functools.cache
def _lengths() -> np.ndarray:
    points = np.arange(sys.maxunicode + 1)
    return (1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.uint8)


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class Bpe:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(path) as f:
            spec = json.load(f)
        self.check_form(spec)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.uint32)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.uint32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64)
        made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.taken = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._index(pairs, made)
        rng = np.random.default_rng(20)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def check_form(spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        ok = kinds == ["NFC", "Replace", "Lowercase"] and split["pattern"] == {"Regex": PATTERN} and level["type"] == "ByteLevel"
        plain = all(not t[k] for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not ok or not plain or not spec["model"]["end_of_word_suffix"] or len(spec["model"]["vocab"]) >= 1 << 31:
            raise ValueError("not a vocabulary of the form that this module reads")

    def _index(self, pairs: np.ndarray, made: np.ndarray) -> None:
        """An open hash table from a pair of ids to its rank."""
        bits = max(8, int(len(pairs) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.zeros(1 << bits, np.int32)
        self.made = made
        left = np.arange(len(pairs))
        at = self._slot(pairs)
        while len(left):
            free = self.keys[at] == np.iinfo(np.uint64).max
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = pairs[left[put]], left[put]
            left, at = left[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or the largest int32."""
        out = np.full(len(pairs), np.iinfo(np.int32).max, np.int32)
        at, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            found = self.keys[at]
            same = found == pairs[left]
            out[left[same]] = self.ranks[at[same]]
            go = ~same & (found != np.iinfo(np.uint64).max)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    # -- pre-tokens ----------------------------------------------------------------------------------------------
    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() or "Σ" not in text and "İ" not in text else "".join(map(str.lower, text))

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, begin and end of each pre-token there, and pre-tokens by text."""
        texts = [self.normalise(t) for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kind = _classes()[points]
        starts = np.empty(len(points), bool)
        if len(points):
            starts[0] = True
            np.not_equal(kind[1:], kind[:-1], out=starts[1:])
            starts |= kind == DIGIT
            self._contractions(points, kind, starts)
        begin = np.flatnonzero(starts)
        token = kind[begin] != SPACE
        end = np.r_[begin[1:], len(points)][token]
        begin = begin[token]
        width = _lengths()[points]
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        raw = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        edges = np.searchsorted(begin, np.cumsum(lengths))
        return raw, place[begin], place[end], np.diff(np.r_[0, edges])

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> None:
        """Mark the begin of a contraction's rest as inside, and what follows it as a new pre-token.

        The pattern tries a contraction only where a match may start: at the first of a run of other characters.
        """
        for i in np.flatnonzero((points == 39) & starts).tolist():
            j = i
            while True:  # after a contraction a match starts anew, perhaps with another contraction
                tail = points[j : j + 3].tolist()
                size = next((len(c) for c in CONTRACTIONS if [*map(ord, c)] == tail[: len(c)]), 0)
                if not size:
                    break
                starts[j] = True
                starts[j + 1 : j + size] = False
                j += size
                if j < len(points):
                    starts[j] = True
                if j >= len(points) or points[j] != 39:
                    break

    def distinct(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of one of each distinct pre-token, and for each pre-token the number of its kind."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        power = np.full(len(raw) + 1, 0xD1342543DE82EF95, np.uint64)
        power[0] = 1
        with np.errstate(over="ignore"):
            # A sum of values times powers over [begin, end), shifted to begin: powers are odd, so they have inverses.
            np.multiply.accumulate(power, out=power)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.values[raw] * power[:-1], out=total[1:])
            h = (total[end] - total[begin]) * power[len(raw) - begin]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= (end - begin).astype(np.uint64)
        _, first, kinds = np.unique(h, return_index=True, return_inverse=True)
        apart = np.flatnonzero(~self._same(raw, begin, end, first[kinds]))
        if len(apart):  # equal hashes of different bytes
            found: dict[bytes, int] = {}
            more = []
            for i in apart.tolist():
                key = raw[begin[i] : end[i]].tobytes()
                if key not in found:
                    found[key] = len(first) + len(more)
                    more.append(i)
                kinds[i] = found[key]
            first = np.r_[first, more]
        return first, kinds

    @staticmethod
    def _same(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, wide: int = 64) -> np.ndarray:
        """Whether each pre-token has the bytes of pre-token `other`."""
        size = end - begin
        same = size == size[other]
        left = np.flatnonzero(same & (other != np.arange(len(other))))
        for i in left[size[left] > wide].tolist():
            a, b, n = begin[i], begin[other[i]], size[i]
            same[i] = bool((raw[a : a + n] == raw[b : b + n]).all())
        left = left[size[left] <= wide]
        padded = np.r_[raw, np.zeros(8, np.uint8)]
        eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
        for step in range(0, wide, 8):
            left = left[size[left] > step]
            if not len(left):
                break
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(size[left] - step, 8).astype(np.uint64))
            same[left] &= (eights[begin[left] + step] ^ eights[begin[other[left]] + step]) & mask == 0
        return same

    # -- merges --------------------------------------------------------------------------------------------------
    def merge(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens one after the other, and the number of each."""
        size = end - begin
        where = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ids = self.inner[raw[where]]
        last = np.cumsum(size) - 1
        ids[last] = self.final[raw[end - 1]]
        word = np.repeat(np.arange(len(size)), size)
        done_ids, done_word = [], []
        top = np.iinfo(np.int32).max
        while len(ids):
            pair = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]
            ranks = np.full(len(ids), top, np.int32)
            ranks[:-1] = self.rank(pair)
            ranks[:-1][word[1:] != word[:-1]] = top
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(ranks, heads)
            counts = np.diff(np.r_[heads, len(ids)])
            spread = np.repeat(best, counts)
            open_ = spread != top
            if not open_.all():
                done_ids.append(ids[~open_])
                done_word.append(word[~open_])
                ids, word, ranks, spread = ids[open_], word[open_], ranks[open_], spread[open_]
                if not len(ids):
                    break
            hit = ranks == spread
            # Of a run of overlapping pairs, every second one is merged, from the left.
            if (over := hit[1:] & hit[:-1] & (word[1:] == word[:-1])).any():
                index = np.arange(len(hit))
                begin_run = np.maximum.accumulate(np.where(hit & ~np.r_[False, over], index, 0))
                hit &= (index - begin_run) % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = self.made[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(size))

    def encode_distinct(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, but very long pre-tokens go through the library."""
        long = np.flatnonzero(end - begin > LONG)
        if not len(long):
            return self.merge(raw, begin, end)
        short = np.flatnonzero(end - begin <= LONG)
        ids, counts = self.merge(raw, begin[short], end[short]) if len(short) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        parts: list = [None] * len(begin)
        cuts = np.r_[0, np.cumsum(counts)]
        for k, w in enumerate(short.tolist()):
            parts[w] = ids[cuts[k] : cuts[k + 1]]
        library = _library(self.path)
        for w in long.tolist():
            text = raw[begin[w] : end[w]].tobytes().decode()
            parts[w] = np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def kinds(self, texts: list[str]):
        """Pre-tokens by text, the kind of each pre-token, ids of all kinds and the number of ids by kind."""
        if self.taken and any(self.taken.search(t) for t in texts):
            return self._kinds_with_added(texts)
        return self._kinds(texts)

    def _kinds_with_added(self, texts: list[str]):
        """As kinds: what stands between added tokens is a text by itself, and each of them is a kind by itself."""
        pieces = [self.taken.split(t) for t in texts]  # every second piece is an added token
        by_piece, kinds, ids, counts = self._kinds(["" if i % 2 else p for found in pieces for i, p in enumerate(found)])
        number = {t: len(counts) + i for i, t in enumerate(self.added)}
        parts, by_text, k = np.split(kinds, np.cumsum(by_piece)[:-1]), [], 0
        for found in pieces:
            for i, p in enumerate(found):
                if i % 2:
                    parts[k + i] = np.array([number[p]])
            by_text.append(sum(map(len, parts[k : k + len(found)])))
            k += len(found)
        more = np.array([*self.added.values()], np.uint32)
        return np.array(by_text, np.int64), np.concatenate(parts).astype(np.int64), np.r_[ids, more], np.r_[counts, np.ones(len(more), np.int64)]

    def _kinds(self, texts: list[str]):
        raw, begin, end, by_text = self.cut(texts)
        first, kinds = self.distinct(raw, begin, end)
        ids, counts = self.encode_distinct(raw, begin[first], end[first])
        return by_text, kinds, ids, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids by text."""
        by_text, kinds, ids, counts = self.kinds(texts)
        size = counts[kinds]
        source = (np.cumsum(counts) - counts)[kinds]
        flat = np.repeat(source - (np.cumsum(size) - size), size) + np.arange(size.sum())
        edges = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(by_text)]]
        return ids[flat], np.diff(edges)

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the number of ids of each of its pre-tokens."""
        by_text, kinds, _, counts = self.kinds(texts)
        return np.split(counts[kinds], np.cumsum(by_text)[:-1]) if len(by_text) else []


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
