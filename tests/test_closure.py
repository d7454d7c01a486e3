"""Closures of graphs with chains, circles and branches, written out block by block."""

import random

import pytest
from pyspark.sql import functions as F
from test_graphs_and_names import closed, reached

from schemaloom.operators import schemas


def named(rng, edges):
    names = [f"n{i:03}" for i in range(400)]
    rng.shuffle(names)
    return [(names[a], names[b]) for a, b in edges]


def tangled(rng):
    """Chains that start and end at nodes of a small random graph, some alone, some closed to circles."""
    edges, free = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(4, 16))], 12
    for _ in range(5):
        n = rng.randrange(1, 14)
        chain = list(range(free, free + n))
        free += n
        edges += zip(chain, chain[1:])
        kind = rng.randrange(4)
        if kind in (1, 3):
            edges.append((rng.randrange(12), chain[0]))
        if kind in (2, 3):
            edges.append((chain[-1], rng.randrange(12)))
        if kind == 0 and rng.random() < 0.5:
            edges.append((chain[-1], chain[0]))
    return named(rng, edges + edges[:2])


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_chains_in_graphs(spark, monkeypatch, block):
    monkeypatch.setattr(schemas, "BLOCK", block)
    rng = random.Random(block)
    many = [(f"{g}:{a}", f"{g}:{b}") for g in range(40) for a, b in tangled(rng)]
    assert closed(spark, many) == reached(many)


def test_a_chain_is_never_held_as_pairs(spark, monkeypatch):
    """Its pairs are the square of its length; what is cut off in the shared folder follows the length."""
    held, cut = [], schemas.checkpointed

    def counted(df):
        out = cut(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(schemas, "checkpointed", counted)
    monkeypatch.setattr(schemas, "BLOCK", 50)
    df = spark.range(300).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    assert schemas.closure(df).count() == 301 * 300 // 2
    assert max(held) <= 300


def test_the_doubling_meets_each_pair_of_a_chain_once(spark):
    df = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = {(r.src, r.dst): r.steps for r in schemas._reach(df).collect()}
    assert found == {(a, b): b - a for a in range(100) for b in range(a + 1, 101)}
