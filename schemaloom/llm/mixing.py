"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

The rate of a source is the mean number of times that one of its documents is to appear. Each document takes its
count from a Poisson distribution with that mean, inverted at a number hashed from its id and the seed, so that a
count depends on nothing but the id, the seed and the rate: a task that is run again, or another order or number of
partitions, gives the same rows. Each document is then repeated by its count and all copies are shuffled globally:
dealt to partitions by a hash of id, copy and seed, and ordered by it there. A hot source is spread like any other.

Rates are a table of one row per source. It is broadcast only if counted to be at most `broadcast_rows` rows;
otherwise documents and rates are joined with a salt, so that a source of a third of all rows is split.

A null source is a source of its own. A row with a null id takes its number from a hash of its columns, so such rows
are dealt out like others; repeated rows share one number. Texts may be null, empty or very long. A source without a target, or with a target that is null, zero or
negative, gives no rows. Columns named like those that are added are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: A rate beyond this is the sum of that many parts, each inverted by itself: exp(-rate) stays far from 0.
PART = 16.0
#: Terms of a part's distribution; beyond them less than 2 ** -53 is left.
TERMS = 100
SALTS = 64


def number(*parts: Column | str) -> Column:
    """A number in (0, 1) of 52 bits from the text of the parts."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """The first terms of the distribution function of a Poisson variable, as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["all"])


def tempered(docs: DataFrame, power: float = 0.5, total: float = 1.0, source: str = "source") -> DataFrame:
    """Rates for weights in proportion to the size of a source to some power, and `total` times as many documents."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(power))
    all_n, all_w = sizes.agg(F.sum("n"), F.sum(weight)).first()
    return sizes.select("source", (weight / F.lit(all_w) * F.lit(all_n) * total / F.col("n")).alias("rate"))


def weighted(docs: DataFrame, weights: dict[str | None, float], total: float = 1.0, source: str = "source") -> DataFrame:
    """Rates for given weights: a source gets its share of `total` times the number of documents."""
    spark = docs.sparkSession
    given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v and v > 0], "s string, w double")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    alive = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")))  # as long as the dict
    all_w = alive.agg(F.sum("w")).first()[0]
    all_n = docs.count()
    return alive.select("source", (F.col("w") / F.lit(all_w) * F.lit(all_n) * total / F.col("n")).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 7, doc_id: str = "doc_id", source: str = "source", copy: str | None = "copy", broadcast_rows: int = 10_000) -> DataFrame:
    """The columns of docs and the number of the copy, from 1; copy=None leaves the number out."""
    kept = [c for c in docs.columns if c != copy]
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if f.name in kept and not re.search(r"map<|variant", f.dataType.simpleString())]
    ident = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null "), F.xxhash64(*hashable).cast("string")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), ident.alias("ident"), F.col(source).alias("src"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = (
        rates.filter("rate > 0")
        .select(F.col("source").alias("of"), "rate", parts.alias("parts"))
        .select("of", "parts", distribution(F.col("rate") / F.col("parts")).alias("cdf"))
    )
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(table), F.col("src").eqNullSafe(F.col("of")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = rows.withColumn("own", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, (F.col("own") == F.col("salt")) & F.col("src").eqNullSafe(F.col("of")))

    def count(j: Column) -> Column:
        u = number("ident", F.lit(seed), j)
        return F.transform(F.array(u), lambda v: F.size(F.filter(F.col("cdf"), lambda c: c <= v)))[0]

    n = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), count), F.lit(0), lambda a, x: a + x)
    copies = joined.select("row", "ident", n.alias("n")).filter("n > 0").select("row", "ident", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    dealt = copies.withColumn("at", F.xxhash64("ident", "k", F.lit(seed)))
    shuffled = dealt.repartition(partitions(docs), "at").sortWithinPartitions("at")
    out = [F.col(f"row.`{c}`").alias(c) for c in kept]
    return shuffled.select(*out, *([F.col("k").alias(copy)] if copy else []))


#: mix(documents, tempered(documents)) for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate FROM sizes),
parts AS (SELECT source, rate / greatest(1, ceil(rate / 16.0)) AS rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM rates),
cdf(source, k, p, c) AS (
  SELECT source, 0, exp(-rate), exp(-rate) FROM parts
  UNION ALL
  SELECT cdf.source, k + 1, p * rate / (k + 1), c + p * rate / (k + 1)
  FROM cdf JOIN parts ON parts.source IS NOT DISTINCT FROM cdf.source WHERE k < 99),
draws AS (
  SELECT doc_id, d.source, j, (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, '7', j::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN (SELECT source, unnest(range(1, parts + 1)) AS j FROM parts) p ON p.source IS NOT DISTINCT FROM d.source),
counts AS (
  SELECT doc_id, draws.source, count(*) AS n FROM draws JOIN cdf ON cdf.source IS NOT DISTINCT FROM draws.source AND cdf.c <= draws.u GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n + 1))::INT AS copy
FROM documents d JOIN counts c ON c.doc_id = d.doc_id AND c.source IS NOT DISTINCT FROM d.source
"""
