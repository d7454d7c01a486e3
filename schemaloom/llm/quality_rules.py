"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps a bit per failed rule and the measurements behind
it; versioned policies are bit masks over the ledger, so that a new policy or an ablation never reads a text
again. A null or empty text has no words: all its measurements are 0 and it fails `few_words`. A null id is kept
as it is. Repeated rows give repeated rows. An empty table gives an empty ledger. Columns other than the id and
the text are ignored, whatever their names. Very long texts cost time in proportion to n log n: their
windows of three words are sorted inside the row, and no row is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, as an array without empty strings."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _windows(words: Column, make) -> Column:
    """make(i) for every window of three words; i counts from 0."""
    n = F.size(words)
    return F.when(n < 3, F.array()).otherwise(F.transform(F.sequence(F.lit(0), n - 3), make))


def _covered(words: Column) -> Column:
    """Number of words inside windows that occur at least twice, exactly, by sorting the windows."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )

    def again(s: Column) -> Column:
        """Positions of the windows that equal a neighbour in the sorted order, in order."""
        near = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def length(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return _let(F.sort_array(windows), lambda s: _let(again(s), length))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more. Equal windows have equal hashes, so a text whose
    window hashes all differ needs no exact comparison."""
    hashes = _windows(words, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    same = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.when(same, _covered(words)).otherwise(F.lit(0)))


def measures(text: Column) -> Column:
    """The measurements of a text, as one struct."""
    t = F.coalesce(text, F.lit(""))

    def per_line(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def per_word(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    chars = lambda x: F.char_length(x).cast("long")
    return F.struct(
        _let(words_of(t), per_word).alias("w"),
        _let(lines(t), per_line).alias("l"),
        chars(F.translate(t, SPACES, "")).alias("word_chars"),
        (chars(t) - chars(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (chars(t) - chars(F.translate(t, "!?", ""))).alias("n_marks"),
    )


@dataclass(frozen=True)
class Rule:
    """A named rule with a fixed bit. fails: a column over the measurements, true where the rule fails."""

    name: str
    bit: int
    fails: object

    @property
    def mask(self) -> int:
        return 1 << self.bit


_c = F.col
RULES = (
    Rule("few_words", 0, lambda: _c("n_words") < 50),
    Rule("repeated_windows", 1, lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbols", 2, lambda: 100 * _c("n_symbols") > 40 * _c("n_words")),
    Rule("shouting", 3, lambda: 100 * _c("n_marks") > 80 * _c("n_words")),
    Rule("duplicate_lines", 4, lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
    Rule("long_words", 5, lambda: _c("word_chars") > 25 * _c("n_words")),
    Rule("poor_vocabulary", 6, lambda: 100 * _c("n_distinct") < 10 * F.least(_c("n_words"), F.lit(2000))),
)
BASE = RULES[0].mask | RULES[1].mask
#: Versions of the policy: which bits reject a document. A version never changes; a new one is added.
POLICIES = {"base": BASE, "v1": BASE | 0b0011100}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_distinct")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements, and fail_bits: bit i is 1 if the rule with that bit fails."""
    m = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text)).alias("m"))
    flat = m.select(
        "doc_id",
        *(F.col(f"m.{p}{n}").alias(n) for n, p in zip(MEASURES, ("w.", "", "", "l.", "w.", "l.", "", "w."), strict=True)),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return flat.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """base_failed and kept, from the stored bits alone."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return rows.withColumns(
        {"base_failed": hit(BASE), "kept": ~hit(POLICIES[version] | BASE), "policy": F.lit(version)}
    )


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    One aggregate over the bits of the ledger; the texts are not read. Rules outside the policy have no row.
    """
    mask = POLICIES[version] | BASE
    rules = [r for r in RULES if r.mask & mask]
    count = lambda c: F.count(F.when(c, 1))
    bits = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    one = rows.agg(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                count(bits(r.mask) != 0).alias("failing"),
                count((bits(r.mask) != 0) & (bits(mask & ~r.mask) == 0)).alias("failing_alone"),
                count(bits(mask & ~r.mask) == 0).alias("kept_without"),
            ).alias(f"r{r.bit}")
            for r in rules
        )
    )
    return one.select(F.inline(F.array(*(F.col(f"r{r.bit}") for r in rules))))


def quality_rules(docs: DataFrame, version: str = "v1") -> DataFrame:
    out = apply_policy(ledger(docs), version)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


#: The same rows for DuckDB. Sorting is not needed: repeated windows are found by grouping.
ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS v
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS covered
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(covered, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             (length(x) - length(regexp_replace(x, '[!?]', '', 'g')))::BIGINT AS n_marks,
             len(list_distinct(ws))::BIGINT AS n_distinct
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_marks > 80 * n_words THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_distinct < 10 * least(n_words, 2000) THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 31) = 0 AS kept, fail_bits
FROM b
"""
