"""Tables of schemas at size: planning is spread over tasks, each schema is planned once, and what is kept is bounded."""

import re

import pytest
from pyspark.sql import functions as F

from schemaloom import catalogue
from schemaloom.operators import memo, schemas

PLANNED_ONCE = ["schema_depth", "schema_more_members", "schema_references_and_constants", "schema_all_of_bounds"]
SPREAD = ["schema_depth", "schema_unions", "schema_transforms", "schema_more_members", "schema_references_and_constants", "schema_optional_members", "schema_all_of_bounds", "schema_dropped_bounds", "schema_roots"]


def test_schemas_of_one_file_are_planned_by_several_tasks(spark):
    df = spark.range(400).coalesce(1).select(F.col("id").alias("name"), F.concat(F.lit('{"type":"string","title":"'), "id", F.lit('"}')).alias("schema"))
    got = schemas.converted(df).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(got) == 4 and sum(r.n for r in got) == 400 and max(r.n for r in got) < 150


@pytest.mark.parametrize("name", PLANNED_ONCE)
def test_a_query_plans_its_schemas_once(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


@pytest.mark.parametrize("name", SPREAD)
def test_a_query_spreads_its_schemas_before_it_plans_them(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"MapInArrow[^\n]*\n[^\n]*Exchange RoundRobinPartitioning\(4\)", plan)


def test_a_text_that_repeats_is_planned_once():
    made, kept = [], memo.Memo()
    make = lambda text: made.append(text) or [(text.upper(), None, 1)]
    assert [kept.get("up", t, make) for t in "abab"] == [[(t.upper(), None, 1)] for t in "abab"] and made == ["a", "b"]
    assert kept.get("none", "a", lambda _: []) == [] and kept.get("none", "a", make) == []


def test_what_is_kept_is_bounded():
    made, kept = [], memo.Memo(limit=20 * (memo.ENTRY + 400))
    make = lambda text: made.append(text) or [(text,)]
    for i in range(500):
        assert kept.get("same", str(i), make) == [(str(i),)] and kept.get("same", "often", make) == [("often",)]
        assert len(kept.young) + len(kept.old) <= 40 and kept.held <= kept.limit
    assert made.count("often") == 1
    assert kept.get("same", "x" * 100_000, make) == [("x" * 100_000,)] and ("same", "x" * 100_000) not in kept.young
