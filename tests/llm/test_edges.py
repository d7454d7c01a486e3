"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from schemaloom.llm import katz, line_dedup, mixing, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, tiff, token_counts

# Names that operators use inside.
CLASH = ("h", "key", "fp", "d", "t", "row", "gone", "bucket", "k", "n", "id", "occ", "copy", "at", "chunk", "part", "blob", "root", "x", "score", "__may", "label")
LONG = "word other and some more of them\n" * 30_000
ROWS = [(1, "a b c d e"), (None, "a b c d e"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "a b c d e"), (6, "a b c d e"), (6, "another text of the same id"), (7, "é" * 300), (-8, "#!? | $")]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") > 2, F.lit("s"))).withColumn("lang", F.lit("en"))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "packing": lambda d: packing.pack(d, queries.tokenizer()),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "mixing": lambda d: mixing.mix(d, mixing.tempered(d)),
    "tiff": lambda d: tiff.digests(d),
    "classifier": lambda d: quality_classifier.classify(d, labels(d.sparkSession, [(1, 0, 0), (2, None, 0), (6, 1, 0), (6, 1, 0)])),
    "accepted": lambda d: quality_classifier.accepted(d, labels(d.sparkSession, [(1, 0, 0), (6, 1, 0)])),
    "mixing_without_numbers": lambda d: mixing.mix(d, mixing.tempered(d), copy=None),
    "packing_after_mixing": lambda d: packing.digests(packing.pack(mixing.mix(d, mixing.tempered(d), copy=None), queries.tokenizer())),
    "token_counts": lambda d: token_counts.token_counts(d, queries.tokenizer(), token_counts.cleaning_edits),
    "simhash": lambda d: simhash.near_duplicates(d),
    "representatives": lambda d: simhash.representatives(d),
    "suffix_dedup": lambda d: suffix_dedup.dedup_passages(d),
    "katz": lambda d: katz.score(d),
}
#: Operators that give a row for each document.
WHOLE = ("quality_rules", "line_dedup", "tiff", "classifier", "token_counts", "simhash", "suffix_dedup", "katz")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    if name in WHOLE:
        assert ids == sorted((d is None, d or 0) for d, _ in ROWS)
    if name == "packing":  # each id of each document once
        assert {i for i in ids} == {(d is None, d or 0) for d, _ in ROWS}
        assert all(len(r.ids) == 4 * r.length for r in got) and len({(r.sequence_id, r.offset) for r in got}) == len(got)
        assert sum(r.length for r in got if r.doc_id in (2, 3)) == 2
    if name == "representatives":
        kept = {(r.doc_id, r.text) for r in got}
        assert (1, "a b c d e") in kept and not {(None, "a b c d e"), (6, "a b c d e")} & kept
        assert len(kept) == len(got) and len({t for d, t in kept if not (t or "").strip()}) == 1
    if name == "line_dedup":
        assert {r.text for r in got if r.doc_id == 5} == {"word other and some more of them\n"}
        assert {(r.doc_id, r.text) for r in got if not (r.text or "").strip(" \t\n")} >= {(2, None), (3, ""), (4, " \n\t ")}
    if name == "accepted":
        assert {(r.doc_id, r.text) for r in got} <= {*ROWS}
    if name == "tiff":
        assert len({tuple(r)[1:] for r in got if r.doc_id in (2, 3)}) == 1
    if name == "token_counts":
        assert all(r.n_tokens == 0 for r in got if r.doc_id in (2, 3, 4))
    if name == "katz":
        assert all(not r.held_out for r in got if r.doc_id is None) and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4))
    if name in ("line_dedup", "mixing", "mixing_without_numbers", "accepted", "representatives"):
        assert all(r[c] == "clash" for r in got for c in CLASH if c != "copy")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, ROWS).limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n in WHOLE if n != "line_dedup"])
def test_same_rows_whatever_the_partitions(spark, name):
    one, many = (sorted(map(str, OPERATORS[name](table(spark, ROWS).repartition(n)).collect())) for n in (1, 5))
    assert one == many


def test_rows_without_an_id_are_dealt_out(spark):
    df = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(id AS STRING) AS text", "'s' AS source")
    got = mixing.mix(df, mixing.tempered(df))
    assert abs(got.count() / 3000 - 1) < 0.1 and got.select("text").distinct().count() > 1500
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_many_lines_of_one_document(spark):
    """Removal is linear: 160,000 repeated lines took over a minute when each was looked up in a list."""
    df = spark.createDataFrame([(1, "\n".join(f"line number {i % 97} of a long text" for i in range(160_000)))], "doc_id long, text string")
    (row,) = line_dedup.dedup_lines(df, removed="n").collect()
    assert (row.n, row.text) == (159_999, "line number 0 of a long text")


def test_pipeline_on_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table(spark, ROWS).select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text")).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
