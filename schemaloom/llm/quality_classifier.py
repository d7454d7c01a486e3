"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken of every whole text in one narrow pass. Trees are fitted on the driver to a bounded sample of
labelled rows (`sample`, 40,000 rows by default, chosen by a hash of the id, all of them if there are fewer); their
size is bounded by `rounds` and `depth`, so the flattened arrays that every task gets are a few kilobytes.
Scoring walks all trees for a batch of rows at once with numpy.

Labels are learned only from rows outside the held-out fold; language, source, id and labels are no inputs.
A null text is empty and is scored like an empty text. A null id is scored, is in no fold and is never learned from.
Null labels are left out. Repeated rows give repeated rows. Without usable labels every score is 0.5; with one class
it is near that class. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_of_id

FEATURES = (
    "chars", "words", "word_length", "word_length_spread", "upper", "lower", "digits", "spaces", "marks", "symbols", "stops",
    "other_ascii", "beyond_ascii", "distinct_words", "commonest_word", "repeated_neighbours", "line_length", "repeated_lines",
    "closed_lines", "compressed", "capitals", "wordless_words",
)
FOLDS, HELD_OUT = 3, 1


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    near = sum(map(bytes.__eq__, words[1:], words))
    of = lambda chars: float(bytes_[list(chars)].sum()) / n
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(bytes_[65:91].sum()) / n,
        float(bytes_[97:123].sum()) / n, float(bytes_[48:58].sum()) / n, of(b" \t\r\n\x0b\x0c"), of(b"!?"), of(b"#*$%&|<>=~^_\\"), of(b".,;:"),
        of(b"\"'()-/@[]{}+`"), float(bytes_[128:].sum()) / n, len(counts) / w, (max(counts.values()) / w if counts else 0.0), near / w,
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip().endswith((b".", b"!", b"?", b":")) for x in lines) / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / n, sum(map(bytes.isupper, words)) / w, sum(not x.isalnum() and not any(c > 127 for c in x[:1]) for x in words) / w,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Trees as arrays: node i of a tree has the children 2i + 1 and 2i + 2; a leaf holds a value at the last level."""

    base: float
    depth: int
    feature: np.ndarray  # trees, inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(feature))]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Model:
    """Logistic loss, quantile bins, one histogram of gradients per level and feature."""
    inner, leaves = 2**depth - 1, 2**depth
    none = Model(0.0, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return none
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    if y.min() == y.max():
        return Model(base, depth, none.feature, none.threshold, none.value)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = bins
    total = np.full(len(y), base)
    forest = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)  # within the level
        for level in range(depth):
            count = 2**level
            best = np.zeros(count)
            pick_f, pick_b = np.zeros(count, int), np.full(count, -1)
            for f in range(x.shape[1]):
                at = node * width + codes[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(axis=1)
                ns = np.bincount(at, minlength=count * width).reshape(count, width).cumsum(axis=1)
                ga, ha, na = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + penalty) + (ga - gs) ** 2 / (ha - hs + penalty) - ga**2 / (ha + penalty)
                gain[(ns < least) | (na - ns < least)] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(count), b]
                better = top > best + 1e-9
                best, pick_f, pick_b = np.where(better, top, best), np.where(better, f, pick_f), np.where(better, b, pick_b)
            for k in range(count):
                i = count - 1 + k
                if pick_b[k] >= 0 and pick_b[k] < len(cuts[pick_f[k]]):
                    feature[i], threshold[i] = pick_f[k], cuts[pick_f[k]][pick_b[k]]
            i = count - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[i]] > threshold[i])
        value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + penalty)
        total += value[node]
        forest.append((feature, threshold, value))
    return Model(base, depth, *(np.stack(v) for v in zip(*forest, strict=True)))


def held_out() -> Column:
    return F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(False))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the statistics of the whole text."""
    out = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch["text"]], out.field("x").type)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], x], schema=out)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def train(rows: DataFrame, labels: DataFrame, sample: int = 40_000, label: str = "quality", **options) -> Model:
    """Fit on labelled rows outside the held-out fold, at most `sample` of them."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    learn = rows.filter(F.col("doc_id").isNotNull() & ~held_out()).join(known.dropDuplicates(), "doc_id")
    got = learn.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).select("x", "label").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0)
    return fit(x.reshape(-1, len(FEATURES)), got["label"].to_numpy().astype(np.float64), **options)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, from stored statistics."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x), pa.float64())], schema=out)

    found = rows.mapInArrow(run, "doc_id bigint, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> DataFrame:
    rows = checkpointed(features(docs))
    return scored(rows, train(rows, labels, sample))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = 40_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, all columns unchanged, without moving a text.

    Statistics are taken twice, once to learn and once to score: that is cheaper than shuffling the texts.
    """
    model = train(features(docs, doc_id, text), labels, sample)

    def run(batches):
        for batch in batches:
            keep = model.score(matrix([t.as_py() for t in batch[text]])) >= 0.5
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
