"""Queries over schemas that differ from row to row, with SQL that tells from the row what must come of its schema.

Each part becomes a JSON Schema whose shape, bounds and depth follow its columns. The schemas are planned in Spark;
the SQL never sees a schema, only the columns that made it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import names, schemas
from .operators.providers import WIRES, Endpoint


def key() -> Column:
    return F.col("p_partkey")


def size() -> Column:
    return F.col("p_size")


def text(*parts) -> Column:
    """JSON text from literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def members(*pairs: tuple[Column | None, Column]) -> Column:
    """An object schema of those members whose condition holds, all required."""
    name = lambda i: f'"f{i}"'
    held = [F.lit(True) if when is None else when for when, _ in pairs]
    fields = F.concat_ws(",", *(F.when(h, F.concat(F.lit(f"{name(i)}:"), s)) for i, (h, (_, s)) in enumerate(zip(held, pairs, strict=True))))
    needed = F.concat_ws(",", *(F.when(h, F.lit(name(i))) for i, h in enumerate(held)))
    return F.concat(F.lit('{"type":"object","properties":{'), fields, F.lit('},"required":['), needed, F.lit("]}"))


def parts(spark, sf_dir: str, schema: Column) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand")
    return found.select(key().cast("bigint").alias("name"), schema.alias("schema"))


def planned(spark, sf_dir: str, schema: Column, **options) -> DataFrame:
    return schemas.converted(parts(spark, sf_dir, schema), options)


TRANSFORMS = "array<struct<type string, path string>>"
DROPPED = "array<struct<path string, constraint string, value string>>"


def listed_transforms() -> Column:
    return F.from_json(F.get_json_object("codec", "$.transforms"), TRANSFORMS)


def listed_dropped() -> Column:
    return F.from_json(F.get_json_object("codec", "$.droppedConstraints"), DROPPED)


def transforms(df: DataFrame) -> DataFrame:
    """name, type and path of each transform."""
    return df.select("name", F.inline(listed_transforms()))


def dropped(df: DataFrame) -> DataFrame:
    return df.select("name", F.inline(listed_dropped()))


def of(path: str, column: str = "converted") -> Column:
    return F.get_json_object(column, path)


def shapes() -> tuple:
    return (
        (size() % 2 == 1, F.lit('{"type":"object","additionalProperties":{"type":"string"}}')),
        (size() % 3 == 0, F.lit("{}")),
        (key() % 5 == 0, F.lit('{"enum":["a",1]}')),
        (key() % 4 == 1, F.lit("true")),
        (None, F.lit('{"type":"string"}')),
    )


#: name -> (SQL, function)
FOUND: dict = {}


def query(sql: str):
    def put(f):
        FOUND[f.__name__] = (sql, f)
        return f

    return put


@query("""SELECT p_partkey::BIGINT AS name, greatest(p_size, p_partkey % 30)::BIGINT AS minimum, least(60 + p_partkey % 17, 60 + p_size % 13)::BIGINT AS maximum, 'integer' AS kind FROM part""")
def schema_all_of_bounds(spark, sf_dir):
    """Bounds and types of all branches are intersected, then recorded as dropped."""
    n = text('{"allOf":[{"type":"number","minimum":', size(), '},{"type":"integer","minimum":', key() % 30, ',"maximum":', 60 + key() % 17, '}],"maximum":', 60 + size() % 13, "}")
    df = planned(spark, sf_dir, members((None, n)))
    found = df.select("name", listed_dropped().alias("found"), of("$.properties.f0.type").alias("kind"))
    bound = lambda word: F.array_max(F.transform(F.filter("found", lambda d: d["constraint"] == word), lambda d: d["value"].cast("bigint"))).alias(word)
    return found.select("name", bound("minimum"), bound("maximum"), "kind")


@query("""SELECT p_partkey::BIGINT AS name, type, count(*) AS n FROM part, LATERAL (SELECT unnest(
    (CASE WHEN p_size % 2 = 1 THEN ['map_to_array'] ELSE [] END) || (CASE WHEN p_size % 3 = 0 THEN ['json_string_parse'] ELSE [] END)
    || (CASE WHEN p_partkey % 5 = 0 THEN ['enum_stringify'] ELSE [] END) || (CASE WHEN p_partkey % 4 = 1 THEN ['json_string_parse'] ELSE [] END)) AS type) GROUP BY ALL""")
def schema_transforms(spark, sf_dir):
    """Maps, opaque values and values of several types, wherever a row's schema has them."""
    return transforms(planned(spark, sf_dir, members(*shapes()))).groupBy("name", "type").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey::BIGINT AS name, '#/properties/' || f AS path, f < 'f' || (p_partkey % 6) AS is_required FROM part, (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4')) v(f) WHERE f >= 'f' || (p_partkey % 6)""")
def schema_optional_members(spark, sf_dir):
    """Members that need not be there become nullable; the first p_partkey % 6 of five are required."""
    needed = F.concat_ws(",", *(F.when(key() % 6 > i, F.lit(f'"f{i}"')) for i in range(5)))
    fields = ",".join(f'"f{i}":{{"type":"string"}}' for i in range(5))
    df = transforms(planned(spark, sf_dir, text(f'{{"type":"object","properties":{{{fields}}},"required":[', needed, "]}")))
    return df.filter("type = 'nullable_optional'").select("name", "path", F.lit(False).alias("is_required"))


@query("""SELECT p_partkey::BIGINT AS name, 1 + p_partkey % 8 AS depth, (p_partkey % 8 >= 5)::INTEGER AS cut, CASE WHEN p_partkey % 8 >= 5 THEN '#' || repeat('/properties/a', 5) END AS path FROM part""")
def schema_depth(spark, sf_dir):
    """Schemas of one to eight levels: beyond the budget of a strict target a string stands for the rest."""
    depth = (1 + key() % 8).cast("int")
    schema = F.concat(F.repeat(F.lit('{"type":"object","required":["a"],"properties":{"a":'), depth), F.lit('{"type":"string"}'), F.repeat(F.lit("}}"), depth))
    found = planned(spark, sf_dir, schema).select("name", listed_transforms().alias("found"))
    levels = (F.col("name") % 8 + 1).alias("depth")
    return found.select("name", levels, F.coalesce(F.array_size("found"), F.lit(0)).alias("cut"), F.array_max("found.path").alias("path"))


@query("""SELECT p_partkey::BIGINT AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'result' END AS wrapper, CASE p_partkey % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'array' ELSE 'string' END AS kind FROM part""")
def schema_roots(spark, sf_dir):
    """Roots that are no object are put into one."""
    schema = F.when(key() % 3 == 0, members((None, F.lit('{"type":"string"}')))).when(key() % 3 == 1, F.lit('{"type":"array","items":{"type":"string"}}')).otherwise(F.lit('{"type":"string"}'))
    df = planned(spark, sf_dir, schema)
    wrapper = F.get_json_object("codec", "$.transforms[0].wrapperKey")
    return df.select("name", wrapper.alias("wrapper"), F.when(wrapper.isNull(), of("$.type")).otherwise(of("$.properties.result.type")).alias("kind"))


@query("""SELECT p_partkey::BIGINT AS name, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'number' ELSE 'boolean' END AS kind, p_brand AS value, '["' || p_brand || '"]' AS listed FROM part""")
def schema_references_and_constants(spark, sf_dir):
    """References are replaced by what they refer to, through either word for definitions; a constant becomes a list of one."""
    kind = F.when(key() % 4 == 0, "string").when(key() % 4 == 1, "integer").when(key() % 4 == 2, "number").otherwise("boolean")
    word = F.when(size() % 2 == 0, "$defs").otherwise("definitions")
    schema = text('{"type":"object","required":["t","c"],"properties":{"t":{"$ref":"#/', word, '/T"},"c":{"const":"', F.col("p_brand"), '"}},"', word, '":{"T":{"type":"', kind, '"}}}')
    df = planned(spark, sf_dir, schema)
    constants = F.filter(listed_dropped(), lambda d: d["constraint"] == "const")
    return df.select("name", of("$.properties.t.type").alias("kind"), of("$.properties.c.enum").alias("listed"), F.get(constants, F.lit(0))["value"].alias("value"))


@query("""SELECT p_partkey::BIGINT AS name, (2 + p_partkey % 3)::BIGINT AS branches, (1 + p_size % 3)::BIGINT AS kinds FROM part""")
def schema_unions(spark, sf_dir):
    """oneOf becomes anyOf, and a list of types becomes branches, or stays one type."""
    one = F.concat_ws(",", *(F.when(key() % 3 >= i - 2, F.lit(f'{{"type":"{t}"}}')) for i, t in enumerate(("string", "integer", "boolean", "null"), 1)))
    kinds = F.concat_ws(",", *(F.when(size() % 3 >= i, F.lit(f'"{t}"')) for i, t in enumerate(("string", "integer", "boolean"))))
    df = planned(spark, sf_dir, members((None, text('{"oneOf":[', one, "]}")), (None, text('{"type":[', kinds, "]}"))))
    count = lambda path: F.size(F.from_json(of(path), "array<struct<type string>>")).cast("bigint")
    union = of("$.properties.f1.anyOf")
    return df.select("name", count("$.properties.f0.anyOf").alias("branches"), F.when(union.isNull(), F.lit(1).cast("bigint")).otherwise(count("$.properties.f1.anyOf")).alias("kinds"))


BANNED = {
    "patternProperties": '{"^a":{"type":"string"}}', "dependentSchemas": '{"a":{"type":"string"}}', "dependentRequired": '{"a":["b"]}', "unevaluatedProperties": "false",
    "contains": '{"type":"string"}', "if": '{"type":"string"}', "then": '{"type":"string"}', "else": '{"type":"string"}', "not": '{"type":"string"}', "$anchor": '"x"',
}
_RULES = ", ".join("'banned_" + {"patternProperties": "pattern_properties", "dependentSchemas": "dependent_schemas", "dependentRequired": "dependent_required", "unevaluatedProperties": "unevaluated_properties"}.get(w, w.strip("$")) + "'" for w in BANNED)


@query(f"""SELECT p_partkey::BIGINT AS name, unnest([[{_RULES}][p_partkey % {len(BANNED)} + 1]] || CASE WHEN p_size % 2 = 0 THEN ['missing_additional_properties'] ELSE [] END
  || CASE WHEN p_size % 3 = 0 THEN ['missing_type'] ELSE [] END || CASE WHEN p_size % 5 = 0 THEN ['missing_items'] ELSE [] END || CASE WHEN p_size % 7 = 0 THEN ['banned_schema_ref'] ELSE [] END) AS rule_id FROM part""")
def schema_audit(spark, sf_dir):
    """What a strict target refuses, by row: a banned keyword each, open objects, nodes without a type, arrays without items, references."""
    banned = F.lit(None)
    for i, (word, value) in enumerate(BANNED.items()):
        banned = F.when(key() % len(BANNED) == i, F.lit(f'"{word}":{value}')).otherwise(banned)
    closed = F.when(size() % 2 == 0, F.lit("")).otherwise(F.lit('"additionalProperties":false,'))
    fields = F.concat_ws(",", F.lit('"s":{"type":"string"}'), F.when(size() % 3 == 0, F.lit('"u":{"title":"x"}')), F.when(size() % 5 == 0, F.lit('"l":{"type":"array"}')), F.when(size() % 7 == 0, F.lit('"r":{"type":"string","$ref":"#"}')))
    return schemas.audited(parts(spark, sf_dir, text('{"type":"object",', closed, banned, ',"properties":{', fields, "}}"))).select("name", "rule_id")


@query("""SELECT p_partkey::BIGINT AS name, (p_partkey % 7)::INTEGER AS dependency_count, CASE WHEN p_size % 4 = 0 THEN '["#/$defs/none"]' ELSE '[]' END AS missing_refs FROM part""")
def schema_dependencies(spark, sf_dir):
    """A component at the head of a chain of p_partkey % 7 others, that ends in a reference to nothing or in a string."""
    n = (key() % 7).cast("int")
    link = lambda i: F.concat(F.lit('"D'), i.cast("string"), F.lit('":{"type":"object","properties":{"x":{"$ref":"#/$defs/D'), (i + 1).cast("string"), F.lit('"}}}'))
    chain = F.when(n > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), link), ","), F.lit(","))).otherwise("")
    last = F.when(size() % 4 == 0, F.lit('{"type":"object","properties":{"x":{"$ref":"#/$defs/none"}}}')).otherwise(F.lit('{"type":"string"}'))
    got = schemas.extracted(parts(spark, sf_dir, text('{"$defs":{', chain, '"D', n, '":', last, "}}")), "#/$defs/D0")
    return got.select("name", "dependency_count", "missing_refs")


@query("""SELECT p_partkey::BIGINT AS name, c.constraint, c.value FROM part, LATERAL (SELECT unnest([
    {'constraint': 'minLength', 'value': (p_size % 5)::VARCHAR}, {'constraint': 'maxLength', 'value': (10 + p_size)::VARCHAR}, {'constraint': 'format', 'value': 'email'}]) AS c)""")
def schema_dropped_bounds(spark, sf_dir):
    """Bounds of texts that a strict target doesn't know are recorded."""
    s = text('{"type":"string","format":"email","minLength":', size() % 5, ',"maxLength":', 10 + size(), "}")
    return dropped(planned(spark, sf_dir, members((None, s)))).select("name", "constraint", "value")


@query("""SELECT p_partkey::BIGINT AS name, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END AS n, CASE WHEN p_size % 2 = 0 THEN '#/properties/_additional' END AS path FROM part""")
def schema_more_members(spark, sf_dir):
    """Named members beside free ones: the free ones move to a member of their own, which is a nullable map."""
    more = F.when(size() % 2 == 0, F.lit(',"additionalProperties":{"type":"integer"}')).otherwise(F.lit(',"additionalProperties":false'))
    df = planned(spark, sf_dir, text('{"type":"object","properties":{"a":{"type":"string"}},"required":["a"]', more, "}"))
    found = df.select("name", listed_transforms().alias("found"))
    return found.select("name", F.coalesce(F.array_size("found"), F.lit(0)).alias("n"), F.array_max("found.path").alias("path"))


def _asked(spark, sf_dir: str, wire: str, prompt: str, schema: str) -> DataFrame:
    """What a request holds of its prompt and of a schema that follows the row."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text"))
    made = json.loads('{"type":"object","properties":{"n":{"type":"integer"}},"required":["n"],"additionalProperties":false}')
    r = df.withColumn("r", WIRES[wire].request(F.col("text"), made, Endpoint("https://example.org/v1", "m")))
    body = lambda p: F.get_json_object("r.body", p)
    return r.select("conv_id", "turn", body(prompt).alias("prompt"), body(f"{schema}.properties.n.type").alias("kind"), F.col("r.url").alias("url"))


_ASKED = "SELECT conv_id, turn, text AS prompt, 'integer' AS kind, 'https://example.org/v1' AS url FROM conversations"


@query(_ASKED)
def provider_request_messages(spark, sf_dir):
    return _asked(spark, sf_dir, "messages", "$.messages[0].content", "$.tools[0].input_schema")


@query(_ASKED)
def provider_request_generate(spark, sf_dir):
    return _asked(spark, sf_dir, "generate", "$.contents[0].parts[0].text", "$.generationConfig.responseSchema")


@query(_ASKED)
def provider_request_responses(spark, sf_dir):
    return _asked(spark, sf_dir, "responses", "$.input", "$.text.format.schema")


@query("""SELECT p_partkey::BIGINT AS name, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS class_name, upper(array_to_string(w, '_')) AS enum_name, array_to_string(w, '_') AS module_name,
    w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel
  FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part)""")
def name_forms(spark, sf_dir):
    """Names of parts as identifiers, from names with blanks, hyphens or capitals inside."""
    found = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    made = F.when(key() % 3 == 0, names.cased(names.words(names.sanitised(F.col("p_name"))), "upper_camel")).when(key() % 3 == 1, F.translate("p_name", " ", "-")).otherwise(F.col("p_name"))
    w = names.words(names.sanitised(made))
    forms = {"class_name": "upper_camel", "enum_name": "shouty", "module_name": "snake", "camel": "lower_camel"}
    return found.select(key().cast("bigint").alias("name"), *(names.cased(w, f).alias(c) for c, f in forms.items()))
