"""Named queries over the test tables, with the SQL that checks them.

Each wraps rows of a table in the documents that a model would have returned for a schema, and takes them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema_queries
from .functions import json_text as J
from .operators import reports, schemas
from .operators.generate import results
from .operators.providers import WIRES, Endpoint
from .operators.rehydrate import rehydrate
from .plans.codec import Codec
from .plans.convert import Plan, convert
from .sources.files import pointer_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rehydrate_events"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(**members: Column) -> Column:
    """JSON text of an object; NULL members are written as null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in members.items())), {"ignoreNullFields": "false"})


def back(df: DataFrame, doc: Column, plan: Plan, **options) -> DataFrame:
    return rehydrate(df.withColumn("document", doc), plan.codec, plan.original, **options)


def at(path: str, kind: str = "string", column: str = "data") -> Column:
    return F.get_json_object(column, path).cast(kind)


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


STRING, INTEGER, NUMBER, BOOLEAN = ({"type": t} for t in ("string", "integer", "number", "boolean"))


def obj(required: str = "", **fields) -> dict:
    return {"type": "object", "properties": fields, "required": required.split()}


def mapping(value: dict) -> dict:
    return {"type": "object", "additionalProperties": value}


# -- transforms ------------------------------------------------------------------------------------------------------

EVENT = obj("id score props tags", id=INTEGER, score={"type": "number", "maximum": 100}, props={}, tags=mapping(STRING), note=STRING)


@query("""SELECT event_id, event_id AS id, least(value, 100.0) AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_type AS tag_type, CAST(user_id AS VARCHAR) AS tag_user, false AS has_note, CASE WHEN value > 100 THEN 3 ELSE 2 END AS n_warnings FROM events""")
def rehydrate_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    tags = F.array(pair(F.lit("type"), F.col("event_type")), pair(F.lit("user"), F.col("user_id").cast("string")))
    doc = document(id=F.col("event_id").cast("string"), score=F.col("value").cast("string"), props=F.col("props"), tags=tags, note=F.lit(None).cast("string"))
    out = back(df, doc, convert(EVENT))
    return out.select(
        "event_id", at("$.id", "bigint").alias("id"), at("$.score", "double").alias("score"), at("$.props.k", "bigint").alias("k"), at("$.tags.type").alias("tag_type"),
        at("$.tags.user").alias("tag_user"), F.array_contains(F.json_object_keys("data"), "note").alias("has_note"), F.size("warnings").alias("n_warnings"),
    )


@query("SELECT event_id, event_type AS name, value * 2 AS value, user_id AS fixed, 2 AS n_members FROM events")
def restore_map_last_wins(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    pairs = F.array(pair(F.col("event_type"), F.col("value")), pair(F.lit("fixed"), F.col("user_id").cast("double")), pair(F.col("event_type"), F.col("value") * 2))
    out = back(df, document(m=pairs), convert(obj("m", m=mapping(NUMBER))))
    members = F.from_json(F.get_json_object("data", "$.m"), "map<string,double>")
    return out.select("event_id", F.col("event_type").alias("name"), members[F.col("event_type")].alias("value"), members["fixed"].cast("bigint").alias("fixed"), F.size(members).alias("n_members"))


@query("SELECT event_id, event_id % 7 = 0 AS kept_as_array, 2 AS n FROM events")
def restore_map_malformed_kept(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    key = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    out = back(df, document(m=F.array(pair(F.lit("a"), F.lit("1")), pair(key, F.lit("2")))), convert(obj("m", m=mapping(STRING))))
    m = F.get_json_object("data", "$.m")
    return out.select("event_id", m.startswith("[").alias("kept_as_array"), F.coalesce(F.json_array_length(m), F.size(F.json_object_keys(m))).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def opaque_parse_props(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props")
    out = back(df, document(p=F.col("props")), convert(obj("p", p={})))
    return out.select("event_id", at("$.p.k", "bigint").alias("k"))


@query("""SELECT event_id, event_id % 5 = 0 AS failed, CASE WHEN event_id % 5 = 0 THEN 'rehydration_error' END AS code,
  CASE WHEN event_id % 5 = 0 THEN props || (CASE WHEN event_id % 2 = 0 THEN ' x' ELSE '}' END) END AS kept FROM events""")
def opaque_parse_error_rows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props")
    bad = F.concat("props", F.when(F.col("event_id") % 2 == 0, " x").otherwise("}"))
    out = back(df, document(p=F.when(F.col("event_id") % 5 == 0, bad).otherwise(F.col("props"))), convert(obj("p", p={})))
    failed = F.col("error").isNotNull()
    return out.select("event_id", failed.alias("failed"), F.col("error.code").alias("code"), F.when(failed, at("$.p")).alias("kept"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + 2)::INT AS n_members,
  o_orderkey % 2 = 0 AS has_status, true AS has_needed FROM orders""")
def nullable_strip_keys(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    doc = document(key=k, needed=F.lit(None).cast("string"), status=F.when(k % 2 == 0, F.col("o_orderstatus")), price=F.when(k % 3 == 0, F.col("o_totalprice")))
    out = back(df, doc, convert(obj("key needed", key=INTEGER, needed={"type": ["string", "null"]}, status=STRING, price=NUMBER)))
    keys = F.json_object_keys("data")
    return out.select("o_orderkey", F.size(keys).alias("n_members"), F.array_contains(keys, "status").alias("has_status"), F.array_contains(keys, "needed").alias("has_needed"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS n_members, CASE WHEN event_id % 4 = 0 THEN value ELSE user_id::DOUBLE END AS fixed,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS extra FROM events""")
def spread_additional(spark, sf_dir):
    """An extra member may overwrite one of the fixed."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    name = F.when(F.col("event_id") % 4 == 0, F.lit("fixed")).otherwise(F.concat(F.lit("x_"), "event_type"))
    doc = document(fixed=F.col("user_id").cast("double"), _additional=F.array(pair(name, F.col("value"))))
    out = back(df, doc, convert({**obj("fixed", fixed=NUMBER), "additionalProperties": NUMBER}))
    members = F.from_json("data", "map<string,double>")
    return out.select("event_id", F.size(members).alias("n_members"), members["fixed"].alias("fixed"), F.try_element_at(members, F.concat(F.lit("x_"), "event_type")).alias("extra"))


TREE = {"$ref": "#/$defs/Node", "$defs": {"Node": obj("value", value=STRING, data={}, children={"type": "array", "items": {"$ref": "#/$defs/Node"}})}}


@query("""SELECT n_nationkey, r_name AS top, n_name AS second, n_name || '!' AS third, n_nationkey::BIGINT AS data_deep
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def recursive_inflate_levels(spark, sf_dir):
    """Trees are nested as JSON as far as the limit goes, and as strings below."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    df = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")

    def level(value: Column, children: Column, data: Column) -> Column:
        return F.struct(value.alias("value"), data.alias("data"), children.alias("children"))

    none, no_data = F.array().cast("array<string>"), F.lit(None).cast("string")
    deep = F.to_json(level(F.concat("n_name", F.lit("!")), none, F.to_json(F.struct(F.col("n_nationkey").alias("k")))), {"ignoreNullFields": "false"})
    second = level(F.col("n_name"), F.array(deep), no_data)
    doc = document(value=F.col("r_name"), children=F.array(second), data=no_data)
    out = back(df, doc, convert(TREE, {"recursion_limit": 1}))
    below = "$.children[0].children[0]"
    return out.select("n_nationkey", at("$.value").alias("top"), at("$.children[0].value").alias("second"), at(f"{below}.value").alias("third"), at(f"{below}.data.k", "bigint").alias("data_deep"))


@query("SELECT r_regionkey, r_name || ',x' AS names, false AS failed FROM region")
def unwrap_root(spark, sf_dir):
    df = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    out = back(df, document(result=F.array(F.col("r_name"), F.lit("x")), more=F.lit(1)), convert({"type": "array", "items": STRING}))
    return out.select("r_regionkey", F.array_join(F.from_json("data", "array<string>"), ",").alias("names"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN 'integer' ELSE 'string' END AS kind, l_linenumber::VARCHAR AS value,
  CASE WHEN l_returnflag = 'N' THEN 'boolean' ELSE 'string' END AS flag_kind FROM lineitem""")
def enum_destringify(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    plan = convert(obj("n flag", n={"enum": [1, 2, 3, 4, "x"]}, flag={"enum": [True, "A", "R"]}))
    out = back(df, document(n=F.col("l_linenumber").cast("string"), flag=F.when(F.col("l_returnflag") == "N", "true").otherwise(F.col("l_returnflag"))), plan)
    kind = lambda p: J.kind(F.try_variant_get(F.parse_json("data"), p, "variant"))
    return out.select("l_orderkey", "l_linenumber", kind("$.n").alias("kind"), at("$.n").alias("value"), kind("$.flag").alias("flag_kind"))


@query("SELECT event_id, user_id::VARCHAR AS first, CAST(json_extract_string(props, '$.k') AS BIGINT) AS second, event_type AS third FROM events")
def tuple_positions(spark, sf_dir):
    """A transform of the second place of a tuple leaves the others."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    codec = Codec([{"type": "json_string_parse", "path": "#/properties/t/prefixItems/1"}])
    out = rehydrate(df.withColumn("document", document(t=F.array(F.col("user_id").cast("string"), "props", "event_type"))), codec, {})
    return out.select("event_id", at("$.t[0]").alias("first"), at("$.t[1].k", "bigint").alias("second"), at("$.t[2]").alias("third"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS by_pattern, props AS other FROM events")
def pattern_properties_filter(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props")
    codec = Codec([{"type": "json_string_parse", "path": "#/patternProperties/^x_[a-z]+$"}])
    out = rehydrate(df.withColumn("document", document(x_props=F.col("props"), y_props=F.col("props"))), codec, {})
    return out.select("event_id", at("$.x_props.k", "bigint").alias("by_pattern"), at("$.y_props").alias("other"))


# -- types and constraints -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS coerced,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '0' || o_orderkey::VARCHAR ELSE ' ' || o_orderkey::VARCHAR END AS kept,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_warnings FROM orders""")
def coerce_integer_roundtrip(spark, sf_dir):
    """Only text that a whole number would be written as becomes one."""
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "0").otherwise(" "), k.cast("string"))
    out = back(df, document(k=text), convert(obj("k", k=INTEGER)))
    kind = J.kind(F.try_variant_get(F.parse_json("data"), "$.k", "variant"))
    return out.select("o_orderkey", F.when(kind == "integer", at("$.k", "bigint")).alias("coerced"), F.when(kind == "string", at("$.k")).alias("kept"), F.size("warnings").alias("n_warnings"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n_number, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS number,
  c_custkey % 2 = 0 AS flag, c_custkey::VARCHAR AS as_text, 'true' AS bool_text FROM customer""")
def coerce_scalars(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    odd = F.col("c_custkey") % 3 == 0
    text = F.when(odd, F.concat(F.col("c_acctbal").cast("string"), F.lit("d"))).otherwise(F.col("c_acctbal").cast("string"))
    doc = document(n=text, b=(F.col("c_custkey") % 2 == 0).cast("string"), s=F.col("c_custkey"), t=F.lit(True))
    out = back(df, doc, convert(obj("n b s t", n=NUMBER, b=BOOLEAN, s=STRING, t=STRING)))
    v = lambda p: F.try_variant_get(F.parse_json("data"), p, "variant")
    told = F.size(F.filter("warnings", lambda w: w["dataPath"] == "/n"))
    return out.select(
        "c_custkey", told.alias("n_number"), F.when(J.kind(v("$.n")) != "string", at("$.n", "double")).alias("number"), F.when(J.kind(v("$.b")) == "boolean", at("$.b", "boolean")).alias("flag"),
        J.string(v("$.s")).alias("as_text"), J.string(v("$.t")).alias("bool_text"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS from_object, CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS from_array,
  1 AS n_warnings FROM events""")
def coerce_union_first_match(spark, sf_dir):
    """Inside a union the first variant of the data's type decides."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    id_ = F.col("user_id").cast("string")
    value = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(id_.alias("id")))).otherwise(F.to_json(F.array(id_)))
    schema = obj("u", u={"anyOf": [obj("id", id=INTEGER), {"type": "array", "items": INTEGER}]})
    out = rehydrate(df.withColumn("document", F.concat(F.lit('{"u":'), value, F.lit("}"))), Codec(), schema)
    v = lambda p: F.try_variant_get(F.parse_json("data"), p, "variant")
    return out.select("event_id", F.when(J.kind(v("$.u.id")) == "integer", at("$.u.id", "bigint")).alias("from_object"), F.when(J.kind(v("$.u[0]")) == "integer", at("$.u[0]", "bigint")).alias("from_array"), F.size("warnings").alias("n_warnings"))


@query("""SELECT p_partkey, greatest(p_size, 10)::BIGINT AS least_10, least(p_size, 40)::BIGINT AS most_40, CASE WHEN p_size <= 10 THEN 11 ELSE p_size END::BIGINT AS over_10,
  CASE WHEN p_size >= 40 THEN 39 ELSE p_size END::BIGINT AS under_40, ((p_size < 10)::INT + (p_size > 40)::INT + (p_size <= 10)::INT + (p_size >= 40)::INT)::INT AS n_warnings,
  CASE WHEN p_size < 10 THEN 'value ' || p_size || ' below minimum 10; clamped' END AS message FROM part""")
def clamp_bounds(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    bound = lambda word, n: {"type": "integer", word: n}
    plan = convert(obj("a b c d", a=bound("minimum", 10), b=bound("maximum", 40), c=bound("exclusiveMinimum", 10), d=bound("exclusiveMaximum", 40)))
    s = F.col("p_size")
    out = back(df, document(a=s, b=s, c=s, d=s), plan)
    message = F.get(F.filter("warnings", lambda w: w["dataPath"] == "/a"), F.lit(0))["message"]
    names = ("least_10", "most_40", "over_10", "under_40")
    return out.select("p_partkey", *(at(f"$.{k}", "bigint").alias(n) for k, n in zip("abcd", names, strict=True)), F.size("warnings").alias("n_warnings"), message.alias("message"))


@query("""SELECT c_custkey, greatest(c_acctbal, 0.5) AS balance, (c_acctbal < 0.5) AS told FROM customer""")
def clamp_fraction(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = back(df, document(b=F.col("c_acctbal")), convert(obj("b", b={"type": "number", "minimum": 0.5})))
    return out.select("c_custkey", at("$.b", "double").alias("balance"), (F.size("warnings") > 0).alias("told"))


@query("""SELECT doc_id, left(text, 80) AS cut, length(text) > 80 AS told,
  CASE WHEN length(text) > 80 THEN 'string length ' || length(text) || ' exceeded maxLength 80; truncated' END AS message FROM documents""")
def truncate_max_length(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = back(df, document(t=F.col("text")), convert(obj("t", t={"type": "string", "maxLength": 80})))
    return out.select("doc_id", at("$.t").alias("cut"), (F.size("warnings") > 0).alias("told"), F.get(F.col("warnings.message"), F.lit(0)).alias("message"))


@query("""SELECT doc_id, least(len(string_split(text, chr(10))), 3)::INT AS n_items, len(string_split(text, chr(10))) > 3 AS told FROM documents""")
def truncate_max_items(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    out = back(df, document(a=F.col("lines")), convert(obj("a", a={"type": "array", "items": STRING, "maxItems": 3})))
    return out.select("doc_id", F.json_array_length(F.get_json_object("data", "$.a")).alias("n_items"), (F.size("warnings") > 0).alias("told"))


@query("""SELECT doc_id, length(text) < 200 AS short_text, len(string_split(text, chr(10))) < 4 AS few_lines FROM documents
  WHERE length(text) < 200 OR len(string_split(text, chr(10))) < 4""")
def violations_min(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    plan = convert(obj("t a", t={"type": "string", "minLength": 200}, a={"type": "array", "items": STRING, "minItems": 4}))
    out = back(df, document(t=F.col("text"), a=F.split("text", "\n")), plan)
    told = lambda word: F.exists("warnings", lambda w: w["kind"]["constraint"] == word)
    return out.filter(F.size("warnings") > 0).select("doc_id", told("minLength").alias("short_text"), told("minItems").alias("few_lines"))


@query("""SELECT page_id, url, '/url' AS data_path FROM pages WHERE NOT regexp_matches(url, '^https://[a-z0-9.-]+/[a-z]+/[0-9]+$')""")
def violations_pattern(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "url")
    plan = convert(obj("url", url={"type": "string", "pattern": "^https://[a-z0-9.-]+/[a-z]+/[0-9]+$"}), {"target": "claude"})
    out = back(df, document(url=F.col("url")), plan)
    return out.select("page_id", "url", F.explode("warnings").alias("w")).select("page_id", "url", F.col("w.dataPath").alias("data_path"))


@query("""SELECT * FROM (SELECT 'minimum' AS constraint, count(*) AS n FROM lineitem WHERE l_quantity < 10
  UNION ALL SELECT 'maximum', count(*) FROM lineitem WHERE l_extendedprice > 50000
  UNION ALL SELECT 'exclusiveMaximum', count(*) FROM lineitem WHERE l_discount >= 0.09) WHERE n > 0""")
def warnings_by_constraint(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    plan = convert(obj("q p d", q={"type": "number", "minimum": 10}, p={"type": "number", "maximum": 50000}, d={"type": "number", "exclusiveMaximum": 0.09}))
    out = back(df, document(q=F.col("l_quantity"), p=F.col("l_extendedprice"), d=F.col("l_discount")), plan)
    # The step below a fractional bound is within rounding, so that the check that follows may tell again; count rows.
    each = out.select(F.explode(F.array_distinct(F.col("warnings.kind.constraint"))).alias("constraint"))
    return each.groupBy("constraint").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, '/turns/1/text' AS path, length(text) AS n FROM conversations WHERE length(text) < 40""")
def warning_paths(spark, sf_dir):
    """Where in an array a value breaks a rule."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    plan = convert(obj("turns", turns={"type": "array", "items": obj("text", text={"type": "string", "minLength": 40})}))
    turns = F.array(F.struct(F.lit("x" * 40).alias("text")), F.struct(F.col("text").alias("text")))
    out = back(df, document(turns=turns), plan)
    return out.select("conv_id", "turn", "text", F.explode("warnings").alias("w")).select("conv_id", "turn", F.col("w.dataPath").alias("path"), F.char_length("text").cast("bigint").alias("n"))


# -- functions -------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, '/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer, url AS back, 1 AS n_segments FROM pages""")
def pointer_escape_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "url")
    p = df.withColumn("pointer", J.pointer(F.lit(""), F.array("url"))).withColumn("s", J.segments(F.col("pointer")))
    return p.select("page_id", "pointer", F.get("s", F.lit(0)).alias("back"), F.size("s").alias("n_segments"))


@query("""SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS folder FROM pages""")
def pointer_folders(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pointer_folder(F.concat(F.lit("#/../"), "url")).alias("folder"))


@query("""SELECT CASE WHEN event_id % 6 = 0 THEN 'null' WHEN event_id % 6 = 1 THEN 'integer' WHEN event_id % 6 = 2 THEN 'number' WHEN event_id % 6 = 3 THEN 'string'
  WHEN event_id % 6 = 4 THEN 'array' ELSE 'object' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def json_type_histogram(spark, sf_dir):
    m = F.col("event_id") % 6
    text = F.when(m == 0, "null").when(m == 1, F.col("user_id").cast("string")).when(m == 2, F.lit("1.5")).when(m == 3, J.quoted(F.col("event_type"))).when(m == 4, "[1]").otherwise(F.col("props"))
    df = table(spark, sf_dir, "events").select(J.kind(F.parse_json(text)).alias("kind"))
    return df.groupBy("kind").agg(F.count("*").alias("n"))


# -- graphs and schemas ----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e(src, dst) AS (
    SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation UNION ALL SELECT 'region' || r_regionkey, 'world' FROM region
    UNION ALL SELECT 'world', 'world' UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey FROM supplier
    UNION ALL SELECT 'step' || s_suppkey, 'step' || s_suppkey + 1 FROM supplier),
  r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
  SELECT src, dst FROM r WHERE src <> dst""")
def component_closure(spark, sf_dir):
    """All that a node needs, over the references between keys, and over a chain as long as the table of suppliers."""

    def edges(name: str, src: str, src_key: str, dst: str, dst_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(src), F.col(src_key)).alias("src"), F.concat(F.lit(dst), F.col(dst_key)).alias("dst"))

    world = table(spark, sf_dir, "region").select(F.concat(F.lit("region"), "r_regionkey").alias("src"), F.lit("world").alias("dst"))
    loop = spark.sql("SELECT 'world' AS src, 'world' AS dst")
    all_ = edges("nation", "nation", "n_nationkey", "region", "n_regionkey").union(world).union(loop).union(edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
    s = F.col("s_suppkey")
    chain = table(spark, sf_dir, "supplier").select(F.concat(F.lit("step"), s).alias("src"), F.concat(F.lit("step"), s + 1).alias("dst"))
    return schemas.closure(all_.union(chain))


SAMPLES = {
    "bounded": obj("name age", name={"type": "string", "minLength": 1}, age={"type": "integer", "minimum": 0, "maximum": 150}, email={"type": "string", "format": "email"}),
    "event": EVENT,
    "maps": obj("h", h=mapping(STRING), m=mapping(mapping(NUMBER))),
    "opaque": obj("a", a={}, b={"type": "object"}),
    "root_list": {"type": "array", "items": STRING},
    "tree": TREE,
}


def _samples(spark) -> DataFrame:
    from .plans.describe import text_of

    return spark.createDataFrame([(k, text_of(v)) for k, v in SAMPLES.items()], "name string, schema string")


@query("""SELECT * FROM (VALUES ('bounded', 'nullable_optional', 1), ('event', 'json_string_parse', 1), ('event', 'map_to_array', 1), ('event', 'nullable_optional', 1),
  ('maps', 'map_to_array', 3), ('maps', 'nullable_optional', 1), ('opaque', 'json_string_parse', 2), ('opaque', 'nullable_optional', 1), ('root_list', 'root_object_wrapper', 1),
  ('tree', 'json_string_parse', 3), ('tree', 'nullable_optional', 8), ('tree', 'recursive_inflate', 1)) AS t(name, type, n)""")
def convert_sample_codecs(spark, sf_dir):
    """Transforms that the conversion of sample schemas records."""
    rows = schemas.converted(_samples(spark))
    kinds = F.from_json("codec", "transforms array<struct<type string>>")["transforms"]["type"]
    return rows.select("name", F.explode(kinds).alias("type")).groupBy("name", "type").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('before', 'missing_additional_properties', 10), ('before', 'missing_type', 2), ('before', 'root_not_object', 2), ('before', 'banned_schema_ref', 2)) AS t(step, rule_id, n)""")
def strict_audit_counts(spark, sf_dir):
    """What a strict provider refuses in the sample schemas, and that it refuses nothing once they are converted."""
    before = _samples(spark)
    after = schemas.converted(before).select("name", F.col("converted").alias("schema"))
    found = schemas.audited(before).withColumn("step", F.lit("before")).union(schemas.audited(after).withColumn("step", F.lit("after")))
    return found.groupBy("step", "rule_id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('tree', '#/$defs/Node', '#/$defs/Node')) AS t(name, src, dst)")
def component_references(spark, sf_dir):
    return schemas.references(_samples(spark))


# -- providers -------------------------------------------------------------------------------------------------------


def _responses(spark, sf_dir, name: str, make) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    raw = df.withColumn("raw", F.when(F.col("turn") % 4 == 3, F.lit('{"nothing": 1}')).otherwise(make(F.col("text"))))
    got = raw.withColumn("x", WIRES[name].extract(F.col("raw")))
    return got.select("conv_id", "turn", F.col("x.content").alias("content"), F.col("x.error").isNotNull().alias("failed"))


_EXTRACTED = "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE {} END AS content, turn % 4 = 3 AS failed FROM conversations"


@query(_EXTRACTED.format("text"))
def provider_extract_chat(spark, sf_dir):
    message = lambda t: document(choices=F.array(F.struct(F.struct(t.alias("content")).alias("message"))))
    return _responses(spark, sf_dir, "chat", message)


@query(_EXTRACTED.format("length(text)::VARCHAR"))
def provider_extract_messages(spark, sf_dir):
    """Tool input comes back as JSON text; its member is taken out of it."""
    tool = lambda t: document(content=F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<n int>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.struct(F.char_length(t).alias("n")).alias("input"))))
    return _responses(spark, sf_dir, "messages", tool).withColumn("content", F.get_json_object("content", "$.n"))


@query(_EXTRACTED.format("CASE WHEN turn % 4 = 2 THEN NULL ELSE text END").replace("turn % 4 = 3 AS failed", "turn % 4 >= 2 AS failed"))
def provider_extract_generate(spark, sf_dir):
    """Every fourth answer was held back for safety."""

    def made(t: Column) -> Column:
        part = F.struct(F.array(F.struct(t.alias("text"))).alias("parts"))
        return document(candidates=F.array(F.struct(F.when(F.col("turn") % 4 == 2, "SAFETY").otherwise("STOP").alias("finishReason"), part.alias("content"))))

    return _responses(spark, sf_dir, "generate", made)


@query(_EXTRACTED.format("text"))
def provider_extract_responses(spark, sf_dir):
    def made(t: Column) -> Column:
        part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
        empty = F.struct(F.lit("reasoning").alias("type"), F.array().cast("array<struct<type string, text string>>").alias("content"))
        return document(output=F.array(empty, F.struct(F.lit("message").alias("type"), F.array(part("output_text", F.lit("")), part("output_text", t)).alias("content"))))

    return _responses(spark, sf_dir, "responses", made)


@query("SELECT conv_id, turn, 'm' AS model, text AS prompt, 'response' AS name, 'application/json' AS content_type FROM conversations")
def provider_request_chat(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    r = df.withColumn("r", WIRES["chat"].request(F.col("text"), convert(EVENT).schema, Endpoint("https://example.org/v1", "m")))
    body = lambda p: F.get_json_object("r.body", p)
    return r.select("conv_id", "turn", body("$.model").alias("model"), body("$.messages[0].content").alias("prompt"), body("$.response_format.json_schema.name").alias("name"), F.col("r.headers")["Content-Type"].alias("content_type"))


@query("SELECT conv_id, turn, length(text)::BIGINT AS n, text AS told, 0 AS n_errors, CAST(NULL AS VARCHAR) AS error FROM conversations")
def generate_roundtrip(spark, sf_dir):
    """From a raw response to a document in its original shape, held against the original schema."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    plan = convert(obj("n told", n=INTEGER, told=mapping(STRING), note=STRING))
    content = document(n=F.char_length("text").cast("string"), told=F.array(pair(F.lit("text"), F.col("text"))), note=F.lit(None).cast("string"))
    raw = df.withColumn("raw_response", document(choices=F.array(F.struct(F.struct(content.alias("content")).alias("message")))))
    out = results(raw, plan, WIRES["chat"])
    return out.select("conv_id", "turn", at("$.n", "bigint").alias("n"), at("$.told.text").alias("told"), F.size("validation_errors").alias("n_errors"), F.col("error.code").alias("error"))


# -- runs over many schemas ------------------------------------------------------------------------------------------

_VERDICT = """CASE {v} % 5 WHEN 0 THEN 'solid_pass' WHEN 1 THEN 'flaky_pass' WHEN 2 THEN 'solid_fail' WHEN 3 THEN 'expected_fail' ELSE 'unexpected_pass' END"""


def _verdict(v: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("solid_pass", "flaky_pass", "solid_fail", "expected_fail", "unexpected_pass"))), (v % 5 + 1).cast("int"))


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same schemas, but for some that are only in one."""
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("schema_"), k, F.lit(".json")).alias("file"))
    old = df.filter(k % 11 != 0).withColumn("verdict", _verdict(k)).withColumn("classification", F.when(k % 2 == 0, _verdict(k)))
    new = df.filter(k % 13 != 0).withColumn("verdict", _verdict(F.floor(k / 5))).withColumn("classification", F.lit(None).cast("string"))
    return old, new


_RUNS = f"""b AS (SELECT 'schema_' || o_orderkey AS name, {_VERDICT.format(v='o_orderkey')} AS v FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT 'schema_' || o_orderkey AS name, {_VERDICT.format(v='(o_orderkey // 5)')} AS v FROM orders WHERE o_orderkey % 13 <> 0)"""
_PASS = "('solid_pass', 'flaky_pass', 'unexpected_pass')"


@query(f"""WITH {_RUNS}, j AS (SELECT coalesce(b.name, c.name) AS name, b.v AS baseline, c.v AS current FROM b FULL JOIN c ON b.name = c.name)
SELECT name, baseline, current, CASE WHEN current IS NULL THEN 'removed' WHEN baseline IS NULL THEN 'added' WHEN baseline = current THEN 'unchanged'
  WHEN baseline = 'expected_fail' AND current IN {_PASS} THEN 'fix' WHEN baseline = 'unexpected_pass' AND current = 'solid_pass' THEN 'config_drift'
  WHEN baseline = 'solid_pass' AND current = 'flaky_pass' THEN 'new_flaky' WHEN baseline IN {_PASS} AND current NOT IN {_PASS} THEN 'new_failure'
  WHEN baseline NOT IN {_PASS} AND current IN {_PASS} THEN 'new_pass' ELSE 'other' END AS transition FROM j""")
def report_diff(spark, sf_dir):
    old, new = _runs(spark, sf_dir)
    return reports.compare(reports.verdicts(old), reports.verdicts(new))


@query(f"""WITH {_RUNS} SELECT name, 'removed' AS side FROM b WHERE name NOT IN (SELECT name FROM c) UNION ALL SELECT name, 'added' FROM c WHERE name NOT IN (SELECT name FROM b)""")
def report_added_removed(spark, sf_dir):
    old, new = map(reports.verdicts, _runs(spark, sf_dir))
    return reports.only_in(old, new).withColumn("side", F.lit("removed")).union(reports.only_in(new, old).withColumn("side", F.lit("added")))


@query(f"""WITH {_RUNS}, u AS (SELECT 'baseline' AS run, v FROM b UNION ALL SELECT 'current', v FROM c)
SELECT run, 100.0::DOUBLE * count(*) FILTER (WHERE v IN {_PASS}) / count(*) FILTER (WHERE v <> 'expected_fail') AS pass_rate FROM u GROUP BY run""")
def pass_rate(spark, sf_dir):
    old, new = map(reports.verdicts, _runs(spark, sf_dir))
    both = old.withColumn("run", F.lit("baseline")).union(new.withColumn("run", F.lit("current")))
    return reports.pass_rate(both, "run")


@query("SELECT true AS regressed")
def regression_gate(spark, sf_dir):
    old, new = map(reports.verdicts, _runs(spark, sf_dir))
    return reports.regressed(reports.compare(old, new))


def _attempts(spark, sf_dir) -> DataFrame:
    e, stages = F.col("event_id"), F.array(*map(F.lit, ("convert", "call", "rehydrate", "validate")))
    attempt = lambda ok, s: F.struct(ok.alias("passed"), s.alias("stage"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"))
    first = attempt(e % 3 == 0, F.lit("call"))
    second = attempt(e % 3 == 1, F.element_at(stages, (e % 4 + 1).cast("int")))
    df = table(spark, sf_dir, "events").select(e, F.concat(F.lit("s"), e, F.lit(".json")).alias("file"), F.when(e % 3 == 0, F.array(first)).otherwise(F.array(first, second)).alias("attempts"))
    return df.withColumn("verdict", reports.verdict(F.col("attempts"))).withColumn("classification", F.lit(None).cast("string"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'convert' WHEN 1 THEN 'call' WHEN 2 THEN 'rehydrate' ELSE 'validate' END AS stage, count(*) AS n FROM events WHERE event_id % 3 = 2 GROUP BY 1""")
def failures_by_stage(spark, sf_dir):
    return reports.failures_by_stage(_attempts(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (CASE event_id % 3 WHEN 0 THEN 'solid_pass' WHEN 1 THEN 'flaky_pass' ELSE 'solid_fail' END)
  WHEN event_id % 3 <> 2 THEN 'unexpected_pass' WHEN event_id % 2 = 0 AND event_id % 4 <> 2 THEN 'solid_fail' ELSE 'expected_fail' END AS classification FROM events""")
def expected_failure_classify(spark, sf_dir):
    """Every fifth schema is expected to fail, those with an even number in the third stage."""
    e = F.col("event_id")
    expected = table(spark, sf_dir, "events").filter(e % 5 == 0).select(F.concat(F.lit("s"), e).alias("name"), F.when(e % 2 == 0, "rehydrate").alias("stage"))
    return reports.classify(_attempts(spark, sf_dir), expected).select("event_id", "classification")


NAMES = """SELECT p_partkey, 'N' || p_partkey % 40 || CASE WHEN p_partkey % 3 = 0 THEN '_2' WHEN p_partkey % 7 = 0 THEN '_3' WHEN p_partkey % 11 = 0 THEN '_2_2' ELSE '' END AS name FROM part"""


@query(rf"""WITH RECURSIVE names AS ({NAMES}),
  ranked AS (SELECT *, lower(name) AS k, regexp_replace(lower(name), '(_\d+)+$', '') AS family, row_number() OVER (PARTITION BY regexp_replace(lower(name), '(_\d+)+$', '') ORDER BY p_partkey) AS i FROM names),
  run(family, i, p_partkey, unique_name, seen) AS (
    SELECT DISTINCT family, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, MAP([''], [0::BIGINT]) FROM ranked
    UNION ALL
    SELECT family, i, p_partkey, CASE WHEN c > 1 THEN name || '_' || c ELSE name END, map_concat(seen, CASE WHEN c > 1 THEN MAP([k, k || '_' || c], [c, 1::BIGINT]) ELSE MAP([k], [c]) END)
    FROM (SELECT r.*, run.seen, (coalesce(run.seen[r.k], 0) + 1)::BIGINT AS c FROM run JOIN ranked r ON r.family = run.family AND r.i = run.i + 1))
  SELECT p_partkey, unique_name FROM run WHERE i > 0""")
def collision_numbering(spark, sf_dir):
    """Names that clash with one another and with given numbers. The SQL goes row by row, with all counts at hand."""
    n = F.col("p_partkey")
    end = F.when(n % 3 == 0, "_2").when(n % 7 == 0, "_3").when(n % 11 == 0, "_2_2").otherwise("")
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("N"), (n % 40).cast("string"), end).alias("name"))
    return reports.numbered(names, "name", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT page_id, url FROM pages ORDER BY md5(concat_ws(':', '42', url)), url LIMIT 20")
def chosen_sample(spark, sf_dir):
    """A seeded sample, a top-k by hash: the number is the feature."""
    return reports.chosen(table(spark, sf_dir, "pages").select("page_id", "url"), "url", 20)


@query("""SELECT event_type, avg(value) AS mean, min(value) AS least, max(value) AS most, (min({'v': value, 'i': event_id})).i AS fastest,
  (max({'v': value, 'i': event_id})).i AS slowest FROM events GROUP BY event_type""")
def timing_by_group(spark, sf_dir):
    return reports.timing(table(spark, sf_dir, "events"), "event_id", "value", "event_type")


for _name, (_sql, _function) in schema_queries.FOUND.items():
    QUERIES[_name], ORACLES[_name] = _function, _sql
