"""The stages of the pipeline, each against brute force on what its predecessor kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from schemaloom.llm import simhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "copies", "mix", "pack"] and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {"input": docs.toPandas().set_index("doc_id")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == COLUMNS
            kept[name] = docs.toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id").quality
    for d, good in truth.items():
        if d in kept["quality"].index:
            assert kept["quality"].text[d] == kept["input"].text[d]
        assert (d in kept["quality"].index) or not good
    assert (truth[[d for d in truth.index if d in kept["quality"].index]] == 0).mean() < 0.05
    before, after = kept["quality"], kept["lines"]
    seen = set()
    for d in sorted(before.index):
        lines = [x for x in before.text[d].split("\n")]
        left = after.text[d].split("\n")
        assert set(left) <= set(lines) | {""} and (left == [""] or [x for x in left if not x.strip()] == [x for x in lines if not x.strip()])
        assert not any(x in seen for x in left if x.strip())
        seen |= {x for x in lines if x.strip()}
    sets = {d: frozenset(simhash.shingles(t, 5).tolist()) for d, t in kept["lines"].text.items()}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            best = min(root[b] for b in sets if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
            changed |= best != root[a]
            root[a] = best
    assert set(kept["copies"].index) == {d for d in root if root[d] == d}
    assert set(kept["mix"].index) <= set(kept["copies"].index)
    pieces = docs.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    copies = kept["mix"].groupby(level=0).size()
    assert all(r.n == r.doc_tokens * copies[r.doc_id] for r in pieces) and {r.doc_id for r in pieces} == set(copies.index)


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    near = [base.replace(base.split()[i], "other", 1) for i in (0, 199)]
    df = spark.createDataFrame([(5, base), (3, near[0]), (9, near[1]), (1, "something else altogether and nothing more"), (5, base)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == [1, 3]


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
