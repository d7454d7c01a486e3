"""The queries of this package and the SQL that checks them. Each reads its whole tables."""

from __future__ import annotations

from . import katz, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, tiff, token_counts
from .common import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer()))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered(docs))


def op5_tiff_pages(spark, sf_dir):
    return tiff.digests(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(), token_counts.cleaning_edits)


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.dedup_passages(table(spark, sf_dir, "documents")))


def op10_katz(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_tiff_pages": op5_tiff_pages,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_katz": op10_katz,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
}
