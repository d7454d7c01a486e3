"""Closures of deep and meeting paths, names that clash with given numbers, and several patterns on one member."""

import json
import random

import pytest
from pyspark.sql import functions as F

from schemaloom.functions.register import register
from schemaloom.operators import names, reports, schemas
from schemaloom.operators.rehydrate import rehydrate
from schemaloom.plans.codec import Codec
from schemaloom.plans.errors import DepthExceeded


def closed(spark, edges, **options):
    df = spark.createDataFrame(edges, "src string, dst string")
    return sorted(map(tuple, schemas.closure(df, **options).collect()))


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = []
    for start in after:
        seen, todo = set(), [start]
        while todo:
            for n in after.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out += [(start, n) for n in seen - {start}]
    return sorted(out)


def test_closure_of_a_chain_of_diamonds_and_of_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(200)]
    assert len(closed(spark, chain)) == 201 * 200 // 2
    ladder = [e for i in range(40) for e in ((f"a{i}", f"l{i}"), (f"a{i}", f"r{i}"), (f"l{i}", f"a{i + 1}"), (f"r{i}", f"a{i + 1}"))]
    assert closed(spark, ladder) == reached(ladder)
    rng = random.Random(4)
    tangle = [(f"x{rng.randrange(30)}", f"x{rng.randrange(30)}") for _ in range(45)]
    assert closed(spark, tangle) == reached(tangle) and closed(spark, []) == []
    assert closed(spark, chain[:5], max_depth=5) == reached(chain[:5])
    with pytest.raises(DepthExceeded):
        closed(spark, chain[:6], max_depth=5)


def told_apart(names):
    """Name by name, with all counts at hand: a name that was given counts as seen once."""
    seen, out = {}, []
    for name in names:
        key = name.lower()
        seen[key] = seen.get(key, 0) + 1
        out.append(name if seen[key] == 1 else f"{name}_{seen[key]}")
        if seen[key] > 1:
            seen[out[-1].lower()] = 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_that_clash_with_numbers(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a", "a_2"] if not seed else [rng.choice("aAb") + rng.choice(["", "", "", "_2", "_3", "_2_2", "_02", "_2_2_2", "_x"]) for _ in range(60)]
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "i int, name string, own string").repartition(3)
    got = reports.numbered(df, "name", "i").orderBy("i").collect()
    assert [r.unique_name for r in got] == told_apart(names) and {r.own for r in got} == {"kept"}
    assert reports.numbered(df.limit(0), "name", "i").collect() == []


def test_every_pattern_that_matches_applies(spark):
    """A name and two patterns lead to the same member: a string of JSON, whose map is an array of pairs."""
    codec = Codec.of({
        "$schema": "https://example.org/codec/v1", "transforms": [
            {"type": "map_to_array", "path": "#/patternProperties/^x", "keyField": "key"},
            {"type": "json_string_parse", "path": "#/patternProperties/y$"},
            {"type": "json_string_parse", "path": "#/properties/xz"},
        ], "droppedConstraints": [],
    })
    pairs = [{"key": "k", "value": 1}]
    document = {"xy": json.dumps(pairs), "xz": json.dumps(pairs), "x": pairs, "y": json.dumps(pairs), "z": "[]"}
    df = spark.createDataFrame([(json.dumps(document),)], "document string")
    (row,) = rehydrate(df, codec, {}).collect()
    assert json.loads(row.data) == {"xy": {"k": 1}, "xz": {"k": 1}, "x": {"k": 1}, "y": pairs, "z": "[]"}


def test_all_components_as_a_function(spark):
    register(spark)
    schema = json.dumps({"type": "object", "properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "string"}}})
    got = spark.createDataFrame([(schema, None), (None, None)], "s string, o string").select(F.expr("convert_all_components(s, o)").alias("c")).collect()
    found = json.loads(got[0].c)
    assert [c["pointer"] for c in found["components"]] == ["#/$defs/A"] and "schema" in found["full"] and got[1].c is None


def test_identifiers(spark):
    cases = {
        "userProfile": ("UserProfile", "USER_PROFILE", "user_profile", "userProfile"), "HTTPServer": ("HttpServer", "HTTP_SERVER", "http_server", "httpServer"),
        "a-b c": ("ABC", "A_B_C", "a_b_c", "aBC"), "2nd": ("2nd", "2ND", "2nd", "2nd"), "": ("Empty", "EMPTY", "empty", "empty"),
        "XMLHttp2Request": ("XmlHttp2Request", "XML_HTTP2_REQUEST", "xml_http2_request", "xmlHttp2Request"), "A1Bc": ("A1Bc", "A1_BC", "a1_bc", "a1Bc"),
        "user_profile": ("UserProfile_2", "USER_PROFILE_2", "user_profile_2", "userProfile_2"),
    }
    df = spark.createDataFrame([(i, n) for i, n in enumerate(cases)], "i int, name string")
    got = {r.name: tuple(r[c] for c in names.FORMS) for r in names.resolved(df, "name", "i").collect()}
    assert got == cases


def test_a_name_expected_twice_counts_once(spark):
    runs = spark.createDataFrame([("a.json", "solid_fail", [(False, "s1", None, None)])], f"file string, verdict string, attempts array<{reports.ATTEMPT}>")
    twice = spark.createDataFrame([("a", "s2"), ("a", "s1")], "name string, stage string")
    assert [r.classification for r in reports.classify(runs, twice).collect()] == [reports.EXPECTED]
