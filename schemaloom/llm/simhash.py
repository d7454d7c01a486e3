"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than equality alone would need: of `segments` segments, one differs by at
most one bit where 2 * segments > max_bits. Each segment is indexed once per wildcard bit, so that two segments
with at most one different bit share a variant; equal variants are joined and the whole fingerprints verified.

Documents with the same fingerprint are one node from the start. Inside a bucket of equal variants the linked
fingerprints are found by a search that drops what it has reached, so a dense group of n near copies costs about
n comparisons and gives n - 1 links, never all pairs. Buckets beyond `block` fingerprints are split by pieces of the
bits outside their segment, and what is still larger is dealt out in pairs of blocks, so that no task holds a bucket
of unbounded size, and no link is lost.

The pipeline's stage (`representatives`) verifies such links on the sets of shingles, and compares what else shares a
band of MinHash by a search inside each key, to which every member brings its set once: no pair of members is a row.

Texts: null is empty. Without a word the fingerprint is zero, and is linked like any other. A null id can't be the
least id of a component: a component of null ids only has a null id. Repeated rows give repeated rows. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, key_filter, may_hold, partitions, stored
from .components import connected_components

BITS = 64
#: Buckets up to this size are compared side by side, larger ones searched.
SMALL = 16
#: Sharers of a key that are searched as they are; beyond that they meet by the rarest members of their sets.
LARGE = 2048
#: Places of the table of frequencies that tells which members are rare.
PLACES = 1 << 18
#: Parts of a component's rows.
SALTS = 16
#: MinHash of the pipeline's stage: bands, and functions in each.
BANDS, ROWS = 24, 5


def shingles(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles in order; a text of fewer words is one shingle."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six white characters
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], seed) for s, e in zip(starts, last, strict=False)), np.uint64, len(last))


def simhash(hashes: np.ndarray) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half the hashes of the shingles."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    return simhash(shingles(text, words, seed))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. One narrow pass over the texts."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), words, seed) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(got.view(np.int64), pa.int64())], schema=out)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cuts(segments: int) -> list[tuple[int, int]]:
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [*zip(cuts, cuts[1:], strict=False)]


def _variants(segments: int) -> list[tuple[int, int, int]]:
    """For each bit: its segment, and the mask of that segment without the bit, signed."""
    return [(bit, k, _signed((((1 << hi) - (1 << lo)) & ~(1 << bit)))) for k, (lo, hi) in enumerate(_cuts(segments)) for bit in range(lo, hi)]


def _pieces(segments: int, number: int) -> list[list[int]]:
    """For each segment: masks of the bits outside of it, in so many pieces."""
    out = []
    for lo, hi in _cuts(segments):
        rest = [b for b in range(BITS) if not lo <= b < hi]
        out.append([_signed(sum(1 << b for b in rest[len(rest) * j // number : len(rest) * (j + 1) // number])) for j in range(number)])
    return out


def _search(fps: np.ndarray, bits: int, group: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all fingerprints of a bucket that links can reach from one another."""
    left, links = fps, []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            block, frontier = frontier[:group], frontier[group:]
            near = np.bitwise_count(block[:, None] ^ left[None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                reached = left[hit]
                links.append((block[near[:, hit].argmax(axis=0)], reached))
                frontier, left = np.concatenate([frontier, reached]), left[~hit]
    return links


def _bucket_links(bits: int):
    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        key, fp = t["bucket"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        size = np.diff(np.r_[begin, len(key)])
        group = np.repeat(np.arange(len(begin)), size)
        links = [(fp[:0], fp[:0])]
        small = np.flatnonzero(size[group] <= SMALL)
        for step in range(1, SMALL):  # small buckets side by side
            small = small[small + step < len(fp)]
            small = small[group[small] == group[small + step]]
            if not len(small):
                break
            near = small[np.bitwise_count(fp[small] ^ fp[small + step]) <= bits]
            links.append((fp[near], fp[near + step]))
        for s, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            links += _search(fp[s : s + n], bits)
        a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].view(np.int64) if len(pairs) else [], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def links(nodes: DataFrame, max_bits: int = 4, segments: int = 3, block: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp, enough to join all that are linked."""
    if 2 * segments <= max_bits:
        raise ValueError("a pair could differ by two bits in every segment")
    each = F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(k).alias("segment"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, k, m in _variants(segments)))
    # Dealt by another key than that of the distinct fingerprints, which few tasks hold: each row becomes 64.
    spread = nodes.repartition(partitions(nodes), F.xxhash64(F.lit(1), "fp"))
    variants = spread.select("fp", F.inline(each)).select("fp", "segment", F.xxhash64("bit", "rest").alias("key"))
    hot = stored(variants.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("key", F.lit(True).alias("hot")))
    if hot.isEmpty():
        buckets = variants.select("fp", F.col("key").alias("bucket"))
    else:
        marked = variants.join(hot, "key", "left")
        buckets = marked.filter("hot IS NULL").select("fp", F.col("key").alias("bucket")).union(_split(marked.filter("hot"), max_bits, segments, block))
    return buckets.repartition("bucket").mapInArrow(_bucket_links(max_bits), "a bigint, b bigint").distinct()


def _split(members: DataFrame, max_bits: int, segments: int, block: int) -> DataFrame:
    """fp and bucket, for members (fp, segment, key) of buckets beyond `block`.

    Two linked members differ in at most max_bits of the bits outside their segment, so of max_bits + 1 pieces of
    these they share one: a bucket becomes as many buckets for each piece as the piece has values. What is still
    beyond `block`, as a dense group of near copies is, is dealt out in pairs of blocks.
    """
    pieces = F.array(*(F.array(*(F.lit(m) for m in masks)) for masks in _pieces(segments, max_bits + 1)))
    own = F.transform(pieces[F.col("segment")], lambda m, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(m)))
    parts = stored(members.select("fp", F.explode(own).alias("key")))
    large = parts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    dealt = parts.join(large, "key", "left").select("key", "fp", blocks.alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))

    def pair(j: Column) -> Column:
        return F.xxhash64("key", F.least(F.col("own"), j), F.greatest(F.col("own"), j))

    return dealt.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("bucket"))


def _labels(rows: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """fp and root, the least fingerprint that links reach, for every distinct fingerprint."""
    nodes = rows.select("fp").distinct()
    roots = connected_components(links(nodes, max_bits, segments))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5,
    max_bits: int = 7, segments: int = 4, bands: int = BANDS, rows: int = ROWS, block: int = LARGE,
) -> DataFrame:
    """The rows of docs without near copies: of each component the document with the least id stays, a null id last.

    Two documents are linked if the Jaccard similarity of their sets of shingles is at least `similarity`, which is
    computed from the sets; documents with equal sets are one node. Links are found by the fingerprints of the sets, as
    `links` finds them, up to `max_bits`, and verified. At 0.8 two fingerprints differ by 10 bits on average, so these
    are not all: sets that agree in a band of their MinHash, as a pair of similarity s does with probability
    1 - (1 - s ** rows) ** bands, all but 8 in 100,000 at 0.8, are compared too, unless fingerprints have linked them.

    Rows that repeat id and text count as one and only one of them stays; of rows that repeat the least id only, the one
    with the least hash of its text.
    """
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).cast("bigint").alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")).alias("k"),
    )
    key = F.xxhash64("k.last", "k.d", "k.t")
    texts = packed.select("k", key.alias("key"), F.col(f"row.`{text}`").alias("text"))
    marked = _sets(texts, words, lambda found: band_keys(found, bands, rows))
    nodes = stored(marked.groupBy("node").agg(F.min("k").alias("k"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    roots = connected_components(_verified_links(nodes, texts, words, similarity, max_bits, segments, block))
    labels = nodes.select("node", "k").join(roots, "node", "left").select("k", F.coalesce("root", "node").alias("root"))
    kept = labels.groupBy("root").agg(F.min("k").alias("kept")).select(F.col("kept.last").alias("l0"), F.col("kept.d").alias("d0"), F.col("kept.t").alias("t0"), F.xxhash64("kept.last", "kept.d", "kept.t").alias("key0"))
    same = (F.col("key") == F.col("key0")) & F.col("d").eqNullSafe(F.col("d0")) & (F.col("t") == F.col("t0")) & (F.col("last") == F.col("l0"))
    found = packed.select("row", "k.*", key.alias("key")).join(kept, same, "left_semi")
    once = found.groupBy("key", "last", "d", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 42) -> list[int]:
    """A key for each band of the MinHash of a set: the band and the least of its hashes under `rows` functions."""
    if not len(hashes):
        return []
    factors = np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        mixed = hashes[i : i + 256, None] * factors
        np.minimum(least, mixed.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[j * rows : (j + 1) * rows].tobytes(), j) for j in range(bands)]


def _sets(texts: DataFrame, words: int, keys=None) -> DataFrame:
    """k, node (a hash of the set of shingles), fp (its fingerprint) and keys, from k and text; or node and the set, if no keys are given."""
    flat = texts.select("k.last", "k.d", "k.t", "text")

    def run(batches):
        for batch in batches:
            node, fp, values = [], [], []
            for t in batch["text"]:
                one = np.unique(shingles(t.as_py(), words))
                node.append(xxhash.xxh64_intdigest(one.tobytes()))
                fp.append(simhash(one) if keys else 0)
                values.append(np.array(keys(one) if keys else one, np.uint64).view(np.int64))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)] + [pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("last", "d", "t")), *columns], names=["last", "d", "t", "node", "fp", "values"])

    out = flat.mapInArrow(run, "last boolean, d bigint, t bigint, node bigint, fp bigint, values array<bigint>")
    return out.select(F.struct("last", "d", "t").alias("k"), "node", "fp", F.col("values").alias("keys")) if keys else out.select("node", F.col("values").alias("set"))


def _verified_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, max_bits: int, segments: int, block: int) -> DataFrame:
    """Links (a, b) of at least that similarity between nodes: those found by fingerprints, and enough to join all that links among sharers of a key join."""
    # Nodes of one fingerprint meet the least of them; it stands for them in links of fingerprints.
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    near = links(nodes.select("fp").distinct(), max_bits, segments).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = nodes.select("node", "fp").join(least, "fp").filter("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y"))
    pairs = stored(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same.select("x", "y")))
    variants = nodes.select("node", F.explode("keys").alias("key"))
    # Keys of the same members are one key.
    sizes = variants.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"))
    shared = stored(sizes.filter("lo <> hi").groupBy("lo", "hi", "n", "all").agg(F.min("key").alias("key")).select("key", "n"))
    members = stored(may_hold(variants, "key", key_filter(shared, "key")).filter("__may").drop("__may").join(shared, "key"))
    used = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    ours = stored(nodes.select("node", "k").join(used, "node", "left_semi").select("node", F.xxhash64("k.last", "k.d", "k.t").alias("key")))
    read = may_hold(texts, "key", key_filter(ours, "key")).filter("__may")
    sets = stored(_sets(read, words).join(ours.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = checkpointed(both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("j")).filter(F.col("j") >= similarity).select("a", "b"))

    # Nodes of one label are joined: each is linked to it or is it.
    labels = found.select(F.col("b").alias("node"), F.col("a").alias("label")).groupBy("node").agg(F.min("label").alias("label"))
    hot = members.filter(F.col("n") > block)
    if hot.isEmpty():
        buckets = _open(_labelled(members.select("node", F.col("key").alias("bucket")), labels))
    else:
        labels = checkpointed(connected_components(found).select("node", F.col("root").alias("label")))
        few = _labelled(members.filter(F.col("n") <= block).select("node", F.col("key").alias("bucket")), labels)
        buckets = _open(few).union(_by_prefixes(hot.select("node").distinct(), sets, labels, similarity, block))
    return found.union(_searched(buckets, sets, similarity))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))


def _open(members: DataFrame) -> DataFrame:
    """The members (bucket, node, label) of buckets with more than one label."""
    labels = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return members.join(labels.filter("lo <> hi").select("bucket"), "bucket", "left_semi")


def _prefix(found: np.ndarray, seen: np.ndarray, similarity: float) -> np.ndarray:
    """The hashes of a set that come first by frequency: two sets of that similarity have one of these in common."""
    keep = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
    return found[np.lexsort((found, seen[found & (len(seen) - 1)]))[:keep]]


def _by_prefixes(nodes: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, block: int) -> DataFrame:
    """bucket, node and label, for nodes that share keys with very many.

    Sets of that similarity share one of their rarest hashes, and those of a large group that are not similar differ in
    these. Any order of the hashes is right; theirs comes from a table of bounded size. A bucket that is large even so
    and is not joined yet is dealt out in pairs of blocks.
    """
    ours = stored(sets.join(nodes, "node", "left_semi"))
    places = ours.select(F.explode("set").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(PLACES - 1)).alias("place")).agg(F.count("*").alias("n"))
    seen = np.zeros(PLACES, np.int64)
    for place, n in places.collect():  # at most PLACES rows
        seen[place] = n

    def run(batches):
        for batch in batches:
            first = [_prefix(s.values.to_numpy(), seen, similarity) for s in batch["set"]]
            node = np.repeat(batch["node"].to_numpy(), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *first]))], names=["node", "bucket"])

    members = stored(_open(_labelled(ours.mapInArrow(run, "node bigint, bucket bigint"), labels)))
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    dealt = members.join(large, "bucket", "left").select("bucket", "node", "label", blocks.alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def pair(j: Column) -> Column:
        return F.xxhash64("bucket", F.least(F.col("own"), j), F.greatest(F.col("own"), j))

    return dealt.select("node", "label", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("bucket")).select("bucket", "node", "label")


def _similar(label: np.ndarray, values: np.ndarray, size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of at least that similarity that join all members that such links join; members of a label are joined already.

    values: the sets, one after another. What a search has reached is not compared again but with what it has not.
    """
    _, ids = np.unique(values, return_inverse=True)
    mark = np.zeros(len(ids), bool)
    begin = np.cumsum(size) - size
    left, links = np.arange(len(size)), []
    here, tokens, starts = left, ids, begin  # the members whose hashes are at hand: at least half of them are left
    while len(left):
        first = label[left] == label[left[0]]
        frontier, left = left[first].tolist(), left[~first]
        while frontier and len(left):
            if 2 * len(left) < len(here):
                here = left
                tokens, starts = np.concatenate([ids[begin[i] : begin[i] + size[i]] for i in here.tolist()]), np.cumsum(size[here]) - size[here]
            one = frontier.pop()
            own = ids[begin[one] : begin[one] + size[one]]
            mark[own] = True
            common = np.add.reduceat(mark[tokens], starts, dtype=np.int64)[np.searchsorted(here, left)]
            mark[own] = False
            near = left[common / (size[one] + size[left] - common) >= similarity]
            if len(near):
                reached, at = np.unique(label[near], return_index=True)
                links += [(one, i) for i in near[at].tolist()]
                new = np.isin(label[left], reached)
                frontier, left = frontier + left[new].tolist(), left[~new]
    return links


def _searched(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) inside buckets, from bucket, node and label. No pair of members is a row: each brings its set once."""

    def search(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        node, label, size = (t[n].to_numpy() for n in ("node", "label", "size"))
        got = np.array(_similar(label, t["set"].combine_chunks().flatten().to_numpy(), size, similarity), np.int64).reshape(-1, 2)
        return node[got[:, 0]], node[got[:, 1]]

    def run(batches):
        held, at = [], None
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            links = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if held and bucket[s] != at:
                        links.append(search(held))
                        held = []
                    held.append(batch.slice(s, e - s))
                    at = bucket[s]
            if links:
                yield _pairs(links)
        if held:
            yield _pairs([search(held)])

    rows = members.join(sets.select("node", "set", F.size("set").cast("bigint").alias("size")), "node").select("bucket", "node", "label", "size", "set")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in links]), pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 4, words: int = 4, segments: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: the least id of a document that links reach."""
    rows = checkpointed(fingerprints(docs, doc_id, text, words))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(_labels(rows, max_bits, segments), "fp")
    # A fingerprint without links is its own component. Of the others a root may have very many: they are salted.
    alone = F.col("alone")
    named = checkpointed(named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")))
    sizes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = sizes.filter("n > 1").select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    labels = named.join(ids.withColumn("alone", F.lit(False)), ["root", "salt"], "left").select("fp", F.when(alone.isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
