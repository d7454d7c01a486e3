"""Edit-aware token counts: a segment tree of pre-tokens per document.

Leaves are runs between white space, which no token of the vocabulary crosses; a leaf holds its text, its code
points and its tokens, and inner nodes hold sums. An edit descends to the leaves that it touches, takes their
text with the neighbour on either side as context, encodes that region alone and updates the sums above it.
What an edit costs follows the size of the edit and the depth of the tree, not the length of the document.

An edit is (at, removed, inserted): code points from `at` on are replaced. Edits of a document are applied in the
order given, each against the text as the earlier ones left it; offsets beyond the end are cut to the end.
The pass over documents is narrow and works on chunks of bounded size, so nothing is shuffled.

A null text is empty and has 0 tokens. A null id is kept. Repeated rows give repeated rows. Other columns are not
read. An empty table gives an empty result. A null or empty list of edits leaves the count as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 3_000_000
#: Counts of so many regions of at most so many code points are remembered by a task.
REMEMBERED, SHORT = 1 << 14, 256
#: A run between white space, with what white space stands before it. White_Space of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEAF = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
Edit = tuple[int, int, str]


class TokenTree:
    """Sums of code points and tokens over the leaves of a text."""

    def __init__(self, leaves: list[str], tokens: np.ndarray) -> None:
        self.leaves = list(leaves) or [""]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens = np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(leaves)] = [len(x) for x in leaves]
        self.tokens[self.width : self.width + len(leaves)] = tokens
        size = self.width
        while size > 1:
            for a in (self.chars, self.tokens):
                a[size // 2 : size] = a[size : 2 * size].reshape(-1, 2).sum(axis=1)
            size //= 2
        self.encoded = 0

    @classmethod
    def of(cls, text: str, count: Callable[[list[str]], np.ndarray]) -> TokenTree:
        leaves = LEAF.findall(text)
        return cls(leaves, count(leaves) if leaves else np.zeros(0, np.int64))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at`, and the offset of that code point in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                at -= int(self.chars[node])
                node += 1
        return node - self.width, at

    def _before(self, leaf: int) -> int:
        """Code points before a leaf."""
        node, out = self.width + leaf, 0
        while node > 1:
            if node % 2:
                out += int(self.chars[node - 1])
            node //= 2
        return out

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with text in that direction, or the leaf itself at the end. Sums lead past leaves without text."""
        at = self._before(leaf) + (int(self.chars[self.width + leaf]) if step > 0 else -1)
        return self._leaf(at)[0] if 0 <= at < self.chars[1] else leaf

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        chars, tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, at: int, removed: int, inserted: str, count: Callable[[list[str]], np.ndarray]) -> None:
        size = int(self.chars[1])
        at = min(max(at, 0), size)
        stop = min(at + max(removed, 0), size)
        first, offset = self._leaf(at) if at < size else self._end()
        last, tail = self._leaf(stop) if stop < size else self._end()
        begin = "".join(self.leaves[first])[:offset]
        finish = self.leaves[last][tail:]
        left, right = self._beside(first, -1), self._beside(last, 1)
        if left < first:
            begin = self.leaves[left] + begin
        if right > last:
            finish += self.leaves[right]
        region = begin + inserted + finish
        self.encoded += len(region)
        i = left
        while i <= right:
            following = self._beside(i, 1)
            if self.leaves[i]:
                self._put(i, "", 0)
            if following <= i:
                break
            i = following
        self._put(left, region, int(count([region])[0]) if region else 0)

    def _end(self) -> tuple[int, int]:
        size = int(self.chars[1])
        leaf = self._leaf(size - 1)[0] if size else 0
        return leaf, len(self.leaves[leaf])


#: What `cleaning_edits` masks: mail addresses and long numbers.
MASKED = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+|[0-9]{7,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits that drop lines equal to an earlier line of at least 20 code points, and mask addresses and numbers.

    They are ordered from the end to the begin, so that each offset holds when its turn comes.
    """
    out: list[Edit] = []
    if "\n" in text:
        seen: set[str] = set()
        at = 0
        for line in text.split("\n"):
            if len(line) >= 20:
                if line in seen:
                    out.append((at, len(line) + 1, ""))
                seen.add(line)
            at += len(line) + 1
    gone = [(a, a + n) for a, n, _ in out]
    k = 0
    for m in MASKED.finditer(text) if ("@" in text or any(c in text for c in "0123456789")) else ():
        while k < len(gone) and gone[k][1] <= m.start():
            k += 1
        if k == len(gone) or m.end() <= gone[k][0]:
            out.append((m.start(), m.end() - m.start(), "[masked]"))
    return sorted(out, reverse=True)


def counter(tokenizer: str) -> Callable[[list[str]], np.ndarray]:
    """Number of tokens of each text."""
    from .bpe import load

    model = load(tokenizer)

    @functools.lru_cache(REMEMBERED)
    def short(text: str) -> int:
        return int(whole([text])[0])

    def count(texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) <= SHORT:  # the region of an edit
            return np.array([short(texts[0])])
        return whole(texts)

    def whole(texts: list[str]) -> np.ndarray:
        by_text, kinds, _, counts = model.kinds(texts)
        total = np.r_[0, np.cumsum(counts[kinds])]
        return np.diff(total[np.r_[0, np.cumsum(by_text)]])

    return count


SCHEMA = "doc_id bigint, n_tokens bigint, n_edits bigint, n_edited_tokens bigint, n_encoded_chars bigint"
ARROW = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])


def token_counts(docs: DataFrame, tokenizer: str, edits: Callable[[str], list[Edit]] | None = None, doc_id: str = "doc_id", text: str = "text", edits_column: str | None = None) -> DataFrame:
    """Tokens of every document before and after its edits, and the code points that the edits had encoded.

    Edits come from a function of the text, or from an array<struct<at int, removed int, inserted string>> column.
    """

    def run(batches):
        count = counter(tokenizer)

        def flush(rows):
            before = count([t for _, t, _ in rows])
            edited = [i for i, (_, _, e) in enumerate(rows) if e]
            leaves = [LEAF.findall(rows[i][1]) for i in edited]
            tokens = count([x for found in leaves for x in found])
            at, after, encoded = 0, before.copy(), np.zeros(len(rows), np.int64)
            for i, found in zip(edited, leaves, strict=True):
                tree = TokenTree(found, tokens[at : at + len(found)])
                at += len(found)
                for a, n, s in rows[i][2]:
                    tree.edit(a, n, s, count)
                after[i], encoded[i] = tree.total, tree.encoded
            columns = [[k for k, _, _ in rows], before, [len(e) for _, _, e in rows], after, encoded]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

        rows, chars = [], 0
        for batch in batches:
            given = batch["edits"] if edits_column else None
            for i, (key, value) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)):
                value = value.as_py() or ""
                own = edits(value) if edits else []
                if given is not None:
                    own += [(e["at"], e["removed"], e["inserted"] or "") for e in given[i].as_py() or [] if e]
                rows.append((key, value, own))
                chars += len(value)
                if chars >= CHUNK_CHARS:
                    yield flush(rows)
                    rows, chars = [], 0
        if rows:
            yield flush(rows)

    columns = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    if edits_column:
        columns.append(F.col(edits_column).alias("edits"))
    return docs.select(*columns).mapInArrow(run, SCHEMA)
