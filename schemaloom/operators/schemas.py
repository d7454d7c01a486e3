"""Tables of schemas: conversion, audit and components, a schema a row. Planning is Python, batch by batch in Arrow.

It takes up to milliseconds a schema, so a small file of many schemas is first spread over the cores, and a worker
keeps what it made of a text (`memo`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.audit import violations
from ..plans.components import Graph, convert_all, extract_component, list_components
from ..plans.convert import convert, parsed
from ..plans.describe import text_of
from ..plans.errors import DepthExceeded, PlanError
from ..plans.options import Options
from ..plans.tree import ordered
from . import memo
from .lineage import checkpointed


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over as many tasks as a shuffle has. A table's bytes don't tell what its planning takes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _each(df: DataFrame, schema: str, key: str, columns: list[str], rows, made) -> DataFrame:
    """Rows of a function of one schema's text, after its key. A schema that can't be planned gives its error.

    made names the function and its options: equal texts have equal rows under equal names.
    """
    kind = df.schema[key].dataType
    ddl = ", ".join([f"{key} {kind.simpleString()}", *(f"{c}" for c in columns)])
    names = [key, *(c.split(" ")[0] for c in columns)]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch[key].to_pylist(), batch[schema].to_pylist(), strict=True):
                if text is not None:
                    out += [(k, *r) for r in memo.rows_of(made, text, rows)]
            arrays = [pa.array([r[0] for r in out], batch.schema.field(key).type)]
            arrays += [pa.array([r[i + 1] for r in out], types[c.split(" ")[1]]) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return spread(df.select(key, schema)).mapInArrow(run, ddl)


def converted(df: DataFrame, options: dict | Options | None = None, schema: str = "schema", key: str = "name") -> DataFrame:
    """key, converted schema, codec, diagnostics and error of each schema."""
    options = Options.of(options)

    def rows(text: str):
        try:
            plan = convert(text, options)
        except PlanError as e:
            return [(None, None, None, 0, text_of(e.as_dict()))]
        return [(text_of(plan.schema), text_of(plan.codec.as_dict()), text_of(plan.errors), len(plan.codec.transforms), None)]

    return _each(df, schema, key, ["converted string", "codec string", "diagnostics string", "n_transforms int", "error string"], rows, ("converted", options))


def audited(df: DataFrame, schema: str = "schema", key: str = "name") -> DataFrame:
    """key, path, rule_id, message of each violation."""
    return _each(df, schema, key, ["path string", "rule_id string", "message string"], lambda text: violations(parsed(text)), "audited")


def components(df: DataFrame, schema: str = "schema", key: str = "name") -> DataFrame:
    return _each(df, schema, key, ["pointer string"], lambda text: [(p,) for p in list_components(text)], "components")


def references(df: DataFrame, schema: str = "schema", key: str = "name") -> DataFrame:
    """key, src, dst: which component refers to which."""
    return _each(df, schema, key, ["src string", "dst string"], lambda text: Graph(ordered(parsed(text))).edges(), "references")


def extracted(df: DataFrame, pointer: str, schema: str = "schema", key: str = "name") -> DataFrame:
    def rows(text: str):
        try:
            got = extract_component(text, pointer)
        except PlanError as e:
            return [(pointer, None, 0, None, text_of(e.as_dict()))]
        return [(pointer, text_of(got.schema), got.dependency_count, json.dumps(got.missing_refs), None)]

    return _each(df, schema, key, ["pointer string", "component string", "dependency_count int", "missing_refs string", "error string"], rows, ("extracted", pointer))


def converted_components(df: DataFrame, options: dict | Options | None = None, schema: str = "schema", key: str = "name") -> DataFrame:
    """A row for the whole schema (pointer "#") and one for each component; an error stands in its row."""
    options = Options.of(options)

    def rows(text: str):
        try:
            full, parts = convert_all(text, options)
        except PlanError as e:
            return [("#", None, None, None, 0, text_of(e.as_dict()))]
        out = [("#", text_of(full.schema), text_of(full.codec.as_dict()), text_of(full.original), 0, None)]
        for c in parts:
            if c.plan is None:
                out.append((c.pointer, None, None, None, 0, c.error))
            else:
                out.append((c.pointer, text_of(c.plan.schema), text_of(c.plan.codec.as_dict()), text_of(c.extract.schema), c.extract.dependency_count, None))
        return out

    return _each(df, schema, key, ["pointer string", "converted string", "codec string", "original string", "dependency_count int", "error string"], rows, ("converted_components", options))


#: Names of a chain that one row holds while a closure is written out: two such rows make the square of it in pairs.
BLOCK = 1024


def _reach(near: DataFrame, max_depth: int | None = None) -> DataFrame:
    """src, dst and least steps of all pairs, also those of a node with itself over a cycle.

    Pairs of exactly n steps are joined with those of up to n, which makes all of up to 2 n: each pair comes of the
    nodes halfway, and of no others. Rounds follow the logarithm of the depth, and each is cut off in the shared folder.
    """
    known = new = checkpointed(near.select("src", "dst", F.lit(1).alias("steps")))
    n = 1
    while (max_depth is None or n <= max_depth) and not new.isEmpty():
        first = new.filter(F.col("steps") == n).select("src", F.col("dst").alias("__by"))
        then = known.select(F.col("src").alias("__by"), "dst", "steps")
        met = first.join(then, "__by").groupBy("src", "dst").agg((F.min("steps") + n).alias("steps"))
        new = checkpointed(met.join(known, ["src", "dst"], "left_anti").select("src", "dst", "steps"))
        known = known.union(new)
        n *= 2
    return known


def _chains(near: DataFrame) -> DataFrame:
    """chain, node and place (from 1) of nodes on chains, their heads left out: chain is the head's name.

    A step of a chain is the only one out of its source and the only one into its end. Each node asks the one before it,
    then the one that this has found, so rounds follow the logarithm of the length. Circles have no head and are left out.
    """
    single = near.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1")
    alone = near.groupBy("dst").agg(F.count("*").alias("n")).filter("n = 1")
    links = single.join(alone, "dst", "left_semi")
    found = checkpointed(links.select(F.col("src").alias("chain"), F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("place"), F.lit(True).alias("moved")))
    before, moved = -1, found.count()
    while moved and moved != before:  # as long as a chain is not done, each round brings some of its nodes to the head
        up = found.select(F.col("node").alias("chain"), F.col("chain").alias("__up"), F.col("place").alias("__more"))
        asked = found.join(up, "chain", "left")
        found = checkpointed(asked.select(
            F.coalesce("__up", "chain").alias("chain"), "node", (F.col("place") + F.coalesce("__more", F.lit(0))).alias("place"), F.col("__up").isNotNull().alias("moved"),
        ))
        before, moved = moved, found.filter("moved").count()
    return found.join(found.select(F.col("node").alias("chain")), "chain", "left_anti").select("chain", "node", "place")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """src, dst: all that can be reached, a node itself left out. Null ends are left out.

    Chains are made one node each before pairs are looked for; what their members reach is written out at the end, block
    by block, without a shuffle of pairs. Where a limit is given, steps are counted: if something is more than max_depth
    steps away at the least, DepthExceeded is raised.
    """
    near = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())
    if max_depth is not None:
        known = _reach(near, max_depth).filter("src <> dst")
        if deepest := known.filter(F.col("steps") > max_depth).orderBy("steps", "src").first():
            raise DepthExceeded(f"{deepest['dst']} is {deepest['steps']} steps from {deepest['src']}, more than {max_depth}", deepest["src"])
        return known.select("src", "dst")
    inner = checkpointed(_chains(near))
    if inner.isEmpty():
        return _reach(near).filter("src <> dst").select("src", "dst")
    between = near.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    ends = inner.select(F.col("node").alias("src"), "chain")
    pairs = _reach(between.join(ends, "src", "left").select(F.coalesce("chain", "src").alias("src"), "dst"))

    members = inner.union(inner.select("chain", F.col("chain").alias("node"), F.lit(0).cast("bigint").alias("place")).distinct())
    block = F.floor(F.col("place") / BLOCK).alias("block")
    held = F.sort_array(F.collect_list(F.struct("place", "node")))["node"]
    blocks = checkpointed(members.groupBy("chain", block).agg(held.alias("names")))
    lengths = blocks.groupBy("chain").agg(F.count("*").alias("blocks"))

    counts = lambda end: lengths.select(F.col("chain").alias(end), F.col("blocks").alias(f"{end}_blocks"))
    marked = pairs.filter("src <> dst").select("src", "dst").join(counts("src"), "src", "left").join(counts("dst"), "dst", "left")
    plain = "src_blocks IS NULL AND dst_blocks IS NULL"
    numbers = lambda start, end: F.explode(F.sequence(start, end - 1))
    many = lambda end: F.coalesce(f"{end}_blocks", F.lit(1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    other = marked.filter(f"NOT ({plain})").withColumn("i", numbers(zero, many("src"))).withColumn("j", numbers(zero, many("dst"))).select("src", "i", "dst", "j", F.lit(False).alias("around"))
    circles = pairs.filter("src = dst").select(F.col("src").alias("chain"), F.lit(True).alias("around"))
    own = lengths.join(circles, "chain", "left").select("chain", "blocks", F.coalesce("around", F.lit(False)).alias("around")).withColumn("i", numbers(zero, F.col("blocks")))
    own = spread(own).withColumn("j", numbers(F.when(F.col("around"), zero).otherwise(F.col("i")), F.col("blocks"))).select(F.col("chain").alias("src"), "i", F.col("chain").alias("dst"), "j", "around")

    names = lambda end, n: blocks.select(F.col("chain").alias(end), F.col("block").alias(n), F.col("names").alias(f"{end}_names"))
    rows = spread(other.union(own).join(names("src", "i"), ["src", "i"], "left").join(names("dst", "j"), ["dst", "j"], "left"))
    same = (F.col("src") == F.col("dst")) & (F.col("i") == F.col("j"))
    each = rows.select(same.alias("same"), "around", F.coalesce("dst_names", F.array("dst")).alias("to"), F.posexplode(F.coalesce("src_names", F.array("src"))).alias("a", "src"))
    each = each.select("same", "around", "a", "src", F.posexplode("to").alias("b", "dst"))
    written = each.filter(~F.col("same") | (F.col("b") > F.col("a")) | F.col("around") & (F.col("b") != F.col("a"))).select("src", "dst")
    return marked.filter(plain).select("src", "dst").union(written)
