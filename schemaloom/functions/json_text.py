"""JSON as columns: a value is a VARIANT while it is taken apart and JSON text while it is put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WARNING = "struct<dataPath string, schemaPath string, kind struct<type string, constraint string>, message string>"
ERROR = "struct<code string, message string, path string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def as_map(v: Column) -> Column:
    """Members of an object, or NULL for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def text(v: Column) -> Column:
    return F.to_json(v)


def strict_parse(s: Column) -> Column:
    """The value that a text holds and nothing beside, or NULL. Spark's parser leaves out what follows a first value."""
    one = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    return let(as_array(one), lambda a: F.when(F.size(a) == 1, a[0]))


def quoted(s: Column) -> Column:
    """A string as JSON text."""
    return F.to_json(s.cast("variant"))


def kind(v: Column) -> Column:
    """JSON type of a value; integers are told apart from other numbers, 1.0 is none. Bind it where it is used twice."""

    def of(t: Column) -> Column:
        return (
            F.when(t == "STRING", "string")
            .when(t == "BIGINT", "integer")
            .when(t == "BOOLEAN", "boolean")
            .when(t == "VOID", "null")
            .when(t.startswith("OBJECT<"), "object")
            .when(t.startswith("ARRAY<"), "array")
            .when(t.rlike(r"^DECIMAL\((19|2\d|3[0-8]),0\)$"), "integer")
            .when(t.isNotNull(), "number")
        )

    return let(F.schema_of_variant(v), of)


def string(v: Column) -> Column:
    """The string, or NULL for any other value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def name_text(name: Column) -> Column:
    """A member's name as JSON text; most need no escaping."""
    return F.when(name.rlike("^[A-Za-z0-9_ .:/@$-]*$"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(quoted(name))


def members_text(names: Column, values: Column) -> Column:
    """JSON text of an object from its names and the JSON texts of its values; a NULL value is an absent member."""
    pairs = F.zip_with(names, values, lambda k, j: F.concat(name_text(k), F.lit(":"), j))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def object_text(members: Column) -> Column:
    """JSON text of an array of (k, j) in the order given; a NULL j is an absent member."""
    return members_text(members["k"], members["j"])


def array_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items["j"], ","), F.lit("]"))


def escaped(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescaped(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer(parent: Column, segments: Column) -> Column:
    """A pointer from its parent and an array of segments."""
    return F.concat(parent, F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), escaped(s))), ""))


def segments(path: Column) -> Column:
    """Segments of a pointer; the whole document has none."""
    rest = F.regexp_replace(path, "^#", "")
    parts = F.split(F.regexp_replace(rest, "^/", ""), "/")
    return F.when(rest == "", none_of("string")).otherwise(F.transform(parts, unescaped))


def short_number(d: Column) -> Column:
    """A double as a message shows it: no fraction where there is none."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e18)
    return F.when(whole, F.floor(d).cast("bigint").cast("string")).otherwise(F.lower(d.cast("string")))


def number_text(d: Column) -> Column:
    """A double as JSON text that says that it is one."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e16)
    return F.when(whole, F.concat(F.floor(d).cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        F.regexp_replace(F.lower(d.cast("string")), r"\.0e", "e")
    )


def preview(s: Column, length: int, mark: str = "...") -> Column:
    return F.when(F.char_length(s) > length, F.concat(F.left(s, F.lit(length)), F.lit(mark))).otherwise(s)


def schema_name(s: Column) -> Column:
    """Letters, digits, _ and -, at most 64."""
    return F.left(F.regexp_replace(s, "[^a-zA-Z0-9_-]", "_"), F.lit(64))
