"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line with text goes if an earlier line, in the order of document and position, equals it. A line of at least
`min_chars` code points also goes if an earlier one is within one edit of it (a code point put in, taken out or
replaced): in shorter lines one edit is a large part. Lines are judged on the input: a line that goes itself still
counts as an earlier line. Lines of white space alone always stay.

Two lines within one edit share a variant: the same text after at most one deletion, at the same place if a code
point was replaced. All variants of all lines would be as many rows as there are characters, so lines are narrowed
down first, without loss: a line is cut into a few equal blocks, and an edit falls into one of them, so that all
before the block and all after it agree. Keys of (block, all before, all after) are joined; only lines that share a
key go on, with the block as their new window, until windows are short. Then every deletion variant of a window is
emitted as a hashed key. Keys are met by aggregates that keep the earliest line, never by pairs, so a group of n
lines costs n rows; a hot line is one row after the first aggregate. Each line found is verified against its earlier
line with levenshtein() on the whole lines.

A null text is empty and stays null. Null ids count as one document before all others. Rows that repeat id and text
count as one document and get the same result each; rows that repeat an id only are told apart by their text. Other
columns are kept, whatever their names. Empty tables give empty results. Very long lines cost time in proportion
to their length, by the narrowing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, key_filter, may_hold, stored

#: The shortest lines that are matched within one edit.
MIN_CHARS = 20
#: Blocks of a line by round of narrowing, after its halves; then windows are 1/256 of a line, or short.
ROUNDS = (8, 8, 4)
SHORT = 24
FIRST_ID = -(1 << 63)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FIRST_ID)).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")]


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """occ, line, h, h2 and long of all lines with text, from d, t, text. occ orders the occurrences."""
    each = rows.select("d", "t", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    sized = each.withColumn("size", F.char_length(F.btrim("line", F.lit(SPACES)))).filter("size > 0")
    return sized.select(F.struct("d", "t", "pos").alias("occ"), "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), (F.col("size") >= min_chars).alias("long"))


def _blocks(key: Column, window: Column, blocks: int, short: int = SHORT) -> Column:
    """Array of (key, window): for each block of the window, the key of all around it, and the block.

    Of two windows within one edit the shorter has n code points and the other n or n + 1. With blocks of n, an edit in
    block c leaves the first c blocks and all after block c of the shorter as they are. So each window gives keys for
    its own length and for the length one less.
    """
    size = F.char_length(window)

    def of(n: Column) -> Column:
        block = F.floor(n / blocks).cast("int") + 1

        def one(c: Column) -> Column:
            before, after = block * c, F.greatest(n - block * (c + 1), F.lit(0))
            outer = F.xxhash64(key, n, c, F.substr(window, F.lit(1), before), F.substr(window, size - after + 1, after))
            return F.struct(outer.alias("key"), F.substr(window, before + 1, size - before - after).alias("window"))

        return F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), one)

    some = F.array_distinct(F.concat(F.when(size > 0, of(size)).otherwise(F.array()), F.when(size > 1, of(size - 1)).otherwise(F.array())))
    whole = F.array(F.struct(key.alias("key"), window.alias("window")))
    # A short window goes on as it is; one that is longer by one may belong to either kind of pair.
    return F.when(size <= short, whole).when(size == short + 1, F.concat(whole, some)).otherwise(some)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key belongs to more than one line."""
    keys = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(keys, "key")


def near_lines(candidates: DataFrame, rounds: tuple[int, ...]) -> DataFrame:
    """h, h2 of every line with an earlier line within one edit, and h and line of each found, from distinct (h, h2, line, occ).

    Each round is written to the shared folder: the next reads it twice.
    """
    rows = candidates.select(F.lit(0).cast("long").alias("key"), F.col("line").alias("window"), "h", "occ")
    for blocks in rounds:
        rows = stored(_shared(rows.select("h", "occ", F.inline(_blocks(F.col("key"), F.col("window"), blocks)))))
    size = F.char_length("window")
    rows = rows.dropDuplicates(["key", "h", "window"])

    def without(p: Column) -> Column:
        rest = F.concat(F.substr("window", F.lit(1), p), F.substr("window", p + 2, size))
        return F.struct(p.alias("p"), F.xxhash64("key", rest).alias("v"))

    deleted = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), without)).otherwise(F.array())
    variants = F.concat(F.array(F.struct(F.lit(-1).alias("p"), F.xxhash64("key", "window").alias("v"))), deleted)
    each = rows.select("h", "occ", F.inline(variants))
    first = F.min(F.struct("occ", "h"))
    # Replaced: deletions at the same place leave the same. Put in or taken out: one line whole, the other less one.
    same = each.filter("p >= 0").groupBy("v", "p").agg(first.alias("w"), F.max("h").alias("hi"), F.min("h").alias("lo")).filter("hi <> lo").drop("hi", "lo")
    whole, less = F.when(F.col("p") < 0, F.struct("occ", "h")), F.when(F.col("p") >= 0, F.struct("occ", "h"))
    other = each.groupBy("v").agg(F.min(whole).alias("whole"), F.min(less).alias("less")).filter("whole.h <> less.h")
    replaced = each.filter("p >= 0").join(same, ["v", "p"])
    moved = each.join(other, "v").select("h", "occ", F.when(F.col("p") < 0, F.col("less")).otherwise(F.col("whole")).alias("w"))
    found = replaced.select("h", "occ", "w").union(moved).filter("w.occ < occ")
    mine = candidates.select("h", "h2", F.col("line").alias("a"))
    theirs = candidates.select(F.col("h").alias("wh"), F.col("line").alias("b"))
    pairs = found.select("h", F.col("w.h").alias("wh")).distinct().join(mine, "h").join(theirs, "wh")
    return pairs.filter(F.levenshtein("a", "b", 1) >= 0).select("h", "h2", F.col("wh").alias("earlier_h"), F.col("b").alias("earlier"))


def _halves(line: Column, n: Column) -> Column:
    """Keys of a line's halves: for its own length and the length one less, the first and the last of two blocks."""

    def of(m: Column) -> list[Column]:
        block = F.floor(m / 2).cast("int") + 1
        after = F.greatest(m - block, F.lit(0))
        return [F.xxhash64(m, F.lit(0), F.substr(line, n - after + 1, after)), F.xxhash64(m, F.lit(1), F.substr(line, F.lit(1), block))]

    return F.array(*of(n), *of(n - 1))


def removed_lines(rows: DataFrame, min_chars: int = MIN_CHARS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """occ (d, t, pos) of all lines that go, from rows (d, t, text).

    Hashes of all lines are written once; texts are read again only for lines that share half with another.
    """
    lines = _lines(rows, min_chars)
    sized = lines.withColumn("n", F.char_length("line"))
    slim = stored(sized.select("occ", "h", "h2", F.when(F.col("long"), _halves(F.col("line"), F.col("n"))).alias("keys")))
    heads = slim.groupBy("h", "h2").agg(F.min("occ").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    halves = heads.select("h", F.explode("keys").alias("key"))
    shared = stored(halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key"))
    likely = may_hold(halves, "key", key_filter(shared, "key")).filter("__may")
    some = stored(likely.join(shared, "key", "left_semi").select("h").distinct())
    texts = may_hold(lines.filter("long"), "h", key_filter(some, "h")).filter("__may").select("h", "h2", "occ", "line")
    first = F.min(F.struct("occ", "line")).alias("f")
    candidates = texts.join(some, "h", "left_semi").groupBy("h", "h2").agg(first).select("h", "h2", F.col("f.line").alias("line"), F.col("f.occ").alias("occ"))
    near = stored(near_lines(stored(candidates), rounds).select("h", "h2").distinct()).withColumn("near", F.lit(True))
    heads = slim.groupBy("h", "h2").agg(F.min("occ").alias("first"), F.count("*").alias("n")).join(near, ["h", "h2"], "left")
    heads = stored(heads.filter("n > 1 or near").select("h", "h2", "first", "near"))
    hit = may_hold(slim.select("occ", "h", "h2"), "h", key_filter(heads, "h")).filter("__may").drop("__may")
    return hit.join(heads, ["h", "h2"]).filter("near or occ > first").select("occ.d", "occ.t", "occ.pos").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, rounds: tuple[int, ...] = ROUNDS, removed: str | None = None) -> DataFrame:
    """The columns of docs, with the text without the lines that go; `removed` names a column for their number."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keyed(docs, doc_id, text))
    gone = removed_lines(keyed.select("d", "t", F.col(f"row.`{text}`").alias("text")), min_chars, rounds)
    # At most the lines of one document come together.
    gone = stored(gone.groupBy("d", "t").agg(F.collect_list("pos").alias("gone")).withColumn("k", F.xxhash64("d", "t")))
    marked = may_hold(keyed.withColumn("k", F.xxhash64("d", "t")), "k", key_filter(gone, "k"))
    columns = [c for c in docs.columns if c != removed]

    def out(df: DataFrame, value: Column, number: Column) -> DataFrame:
        given = [value.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns]
        return df.select(*given, *([number.cast("int").alias(removed)] if removed else []))

    old = F.col(f"row.`{text}`")
    touched = marked.filter("__may").join(gone.drop("k"), ["d", "t"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(old, "\n")))
    # Places that stay, by a hash set; then each line is taken by its place: linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    changed = out(touched, F.when(F.col("gone").isNull(), old).otherwise(rest), F.coalesce(F.size("gone"), F.lit(0)))
    return changed.union(out(marked.filter("not __may"), old, F.lit(0)))


#: Deletion variants of all lines, without the narrowing: for small tables.
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts),
sized AS (SELECT *, length(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS size FROM lines),
heads AS (SELECT line, any_value(size) AS size, min({{'d': doc_id, 'p': pos}}) AS first FROM sized WHERE size > 0 GROUP BY line),
cuts AS (SELECT line, first, unnest(generate_series(0, length(line))) AS p FROM heads WHERE size >= {MIN_CHARS}),
variants AS (SELECT line, first, p, CASE WHEN p = 0 THEN line ELSE substring(line, 1, p - 1) || substring(line, p + 1) END AS v FROM cuts),
replaced AS (SELECT p, v, min(first) AS least FROM variants WHERE p > 0 GROUP BY p, v),
met AS (SELECT v, min(first) FILTER (WHERE p = 0) AS whole, min(first) FILTER (WHERE p > 0) AS less FROM variants GROUP BY v),
near AS (SELECT DISTINCT line FROM (
  SELECT a.line FROM variants a JOIN replaced r ON a.p = r.p AND a.v = r.v WHERE r.least < a.first
  UNION ALL SELECT a.line FROM variants a JOIN met m ON a.v = m.v WHERE (a.p = 0 AND m.less < a.first) OR (a.p > 0 AND m.whole < a.first))),
marked AS (SELECT s.doc_id, s.pos, s.line, coalesce(s.size > 0 AND ({{'d': s.doc_id, 'p': s.pos}} > h.first OR n.line IS NOT NULL), false) AS gone
  FROM sized s LEFT JOIN heads h ON s.line = h.line LEFT JOIN near n ON s.line = n.line),
rest AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN r.n > 0 THEN coalesce(r.kept, '') ELSE t.text END AS text, r.n::INTEGER AS n_removed FROM texts t JOIN rest r ON t.doc_id = r.doc_id
"""
