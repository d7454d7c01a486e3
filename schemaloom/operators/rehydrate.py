"""From documents as a provider returned them back to the original shape.

A codec is a plan for documents. It is compiled once, on the driver, into column expressions: a tree of paths with
what happens at each, walked once from the root. No Python runs on executors and nothing is shuffled. A document is
taken apart as a VARIANT and put together as JSON text with sorted keys, so that values that fit no type are kept as
they are, and a missing member is not a null.

Three steps, as in the codec's definition: transforms undone, last first; types coerced to the original schema and
dropped bounds enforced; what can't be enforced checked. Warnings stand in that order.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J
from ..plans.codec import Codec, expanded
from ..plans.convert import parsed
from ..plans.describe import text_of
from ..plans.pointer import split
from ..plans.tree import ordered

# Segments of a schema's path that are no step into data, alone or with the segment that follows.
ALONE = {"additionalProperties", "unevaluatedProperties", "unevaluatedItems", "contains", "propertyNames", "not", "if", "then", "else", "prefixItems"}
WITH_NEXT = {"anyOf", "oneOf", "allOf", "$defs", "definitions", "dependentSchemas"}
CONDITIONS = ("if", "then", "else")
PARSES = ("json_string_parse", "recursive_inflate")


@dataclass
class Node:
    """What happens to a value, and to the values inside it."""

    own: list = field(default_factory=list)
    members: dict[str, Node] = field(default_factory=dict)
    patterns: dict[str, Node] = field(default_factory=dict)
    places: dict[int, Node] = field(default_factory=dict)
    items: Node | None = None

    def at(self, segments: list[str]) -> Node | None:
        """The node at a path, made where it is missing; None for a path that leads nowhere."""
        node, rest = self, list(segments)
        while rest:
            step = rest.pop(0)
            if step in ALONE:
                continue
            if step in WITH_NEXT:
                if not rest:
                    return None
                rest.pop(0)
            elif step in ("patternProperties", "properties"):
                if not rest:
                    return None
                group = node.members if step == "properties" else node.patterns
                if step == "patternProperties" and not usable(rest[0]):
                    return None
                node = group.setdefault(rest.pop(0), Node())
            elif step == "items":
                node.items = node.items or Node()
                node = node.items
            elif step.isdigit():
                node = node.places.setdefault(int(step), Node())
            else:
                return None
        return node

    @property
    def bare(self) -> bool:
        return not (self.members or self.patterns or self.places or self.items)

    @staticmethod
    def merged(nodes: list[Node]) -> Node:
        """What happens to a value that several paths lead to, in the codec's order."""
        if len(nodes) == 1:
            return nodes[0]

        def group(name: str) -> dict:
            keys = dict.fromkeys(k for n in nodes for k in getattr(n, name))
            return {k: Node.merged([getattr(n, name)[k] for n in nodes if k in getattr(n, name)]) for k in keys}

        items = [n.items for n in nodes if n.items]
        own = sorted((t for n in nodes for t in n.own), key=lambda t: t["at"])
        return Node(own, group("members"), group("patterns"), group("places"), Node.merged(items) if items else None)

    def named(self, name: str) -> Node | None:
        """What happens to the member of that name: by its name and by every pattern that matches it."""
        found = [self.members[name]] if name in self.members else []
        found += [n for p, n in self.patterns.items() if re.search(p, name)]
        return Node.merged(found) if found else None

    def matched(self) -> list[tuple[list[str], Node]]:
        """Sets of patterns and what happens to a member that matches them, the larger sets first."""
        names = list(self.patterns)
        sets = [c for n in range(len(names), 0, -1) for c in combinations(names, n)]
        return [([*c], Node.merged([self.patterns[p] for p in c])) for c in sets]


def usable(pattern: str) -> bool:
    """Whether a pattern means the same here: no look-around, no references back."""
    if re.search(r"\(\?[=!<]|\\[1-9]|\\k", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def java_pattern(pattern: str) -> str:
    """Classes such as \\d speak of all of Unicode."""
    return "(?U)" + pattern if re.search(r"\\[dDwWsSbB]", pattern) else pattern


def matches(k: Column, patterns: list[str]) -> Column:
    out = k.rlike(java_pattern(patterns[0]))
    for p in patterns[1:]:
        out = out & k.rlike(java_pattern(p))
    return out


# -- first step: transforms ------------------------------------------------------------------------------------------


def _tree(codec: Codec) -> Node:
    root = Node()
    for n, t in enumerate(expanded(codec)):
        segments = t.get("segments") if "segments" in t else split(t["path"])
        if t["type"] == "nullable_optional" and segments[-2:-1] != ["properties"]:
            continue
        if (node := root.at(segments)) is not None:
            node.own.append({**t, "at": n})
    return root


def _error(message: Column, path: str) -> Column:
    return F.struct(F.lit("rehydration_error").alias("code"), message.alias("message"), F.lit(path).alias("path"))


def _changes(node: Node) -> bool:
    """Whether anything is undone at a value or inside it."""
    return bool(node.own) or any(map(_changes, [*node.members.values(), *node.patterns.values(), *node.places.values(), *([node.items] if node.items else [])]))


class Undo:
    """Compiles the transforms. A value becomes a struct: j, its JSON text; e, errors; x, the members of a restored map."""

    MEMBER = "struct<k string, j string>"

    def result(self, j: Column, e: Column, x: Column | None = None) -> Column:
        return F.struct(j.alias("j"), e.cast(f"array<{J.ERROR}>").alias("e"), (x if x is not None else F.lit(None)).cast(f"array<{self.MEMBER}>").alias("x"))

    def value(self, node: Node, v: Column, path: str = "") -> Column:
        kinds = [t["type"] for t in node.own]
        for t in reversed(node.own):
            if t["type"] in PARSES:
                return J.let(self._parsed(v), lambda p, v=v: self._with_error(self._inside(node, p["v"], kinds, path), p["bad"], J.string(v), path))
            if t["type"] == "root_object_wrapper":
                inner = J.as_map(v)[t["wrapperKey"]]
                bad = inner.isNull()
                message = F.lit(f"Expected wrapper key `{t['wrapperKey']}` at root object but it was missing")
                return J.let(
                    F.struct(F.coalesce(inner, v).alias("v"), bad.alias("bad")),
                    lambda p, message=message: J.let(self._inside(node, p["v"], kinds, path), lambda r: self.result(r["j"], F.when(p["bad"], F.array_append(r["e"], _error(message, path or "/"))).otherwise(r["e"]), r["x"])),
                )
            if t["type"] == "enum_stringify":
                v = self._value_of_enum(v, t["originalValues"])
        return self._inside(node, v, kinds, path)

    @staticmethod
    def _parsed(v: Column) -> Column:
        s = J.string(v)
        inner = J.strict_parse(s)
        return F.struct(F.coalesce(inner, v).alias("v"), (s.isNotNull() & inner.isNull()).alias("bad"))

    def _with_error(self, got: Column, bad: Column, s: Column, path: str) -> Column:
        message = F.concat(F.lit("Failed to parse JSON string: "), F.left(s, F.lit(100)), F.lit("..."))
        return J.let(got, lambda r: self.result(r["j"], F.when(bad, F.array_append(r["e"], _error(message, path or "/"))).otherwise(r["e"]), r["x"]))

    @staticmethod
    def _value_of_enum(v: Column, values: list) -> Column:
        s = J.string(v)
        out = None
        for value in values:
            hit = s == F.lit(value if isinstance(value, str) else text_of(value))
            literal = F.parse_json(F.lit(text_of(value)))
            out = F.when(hit, literal) if out is None else out.when(hit, literal)
        return v if out is None else out.otherwise(v)

    def _inside(self, node: Node, v: Column, kinds: list[str], path: str) -> Column:
        nothing = J.none_of(J.ERROR)
        leaf = self.result(J.text(v), nothing)
        mapped = "map_to_array" in kinds
        spread = [t["propertyName"] for t in node.own if t["type"] == "extract_additional_properties"]
        if node.bare and not mapped and not spread:
            return leaf
        objects = bool(node.members or node.patterns or spread)
        arrays = bool(mapped or node.items or node.places)

        def of_array(a: Column) -> Column:
            return F.when(a.isNull(), leaf).otherwise(self._map(node, a, path) if mapped else self._array(node, a, path))

        other = J.let(J.as_array(v), of_array) if arrays else leaf
        if not objects:
            return other
        return J.let(J.as_map(v), lambda m: F.when(m.isNull(), other).otherwise(J.let(F.map_entries(m), lambda e: self._object(node, e, spread, path))))

    def _member(self, node: Node, k: Column, v: Column, path: str) -> Column:
        """What becomes of a member: by its name and by every pattern that its name matches."""
        plain = self.result(J.text(v), J.none_of(J.ERROR))
        out = None
        for name in node.members:
            child = node.named(name)
            got = self.value(child, v, f"{path}/{name}")
            if any(t["type"] == "nullable_optional" and not t.get("originalRequired") for t in child.own):
                got = F.when(F.is_variant_null(v), self.result(F.lit(None).cast("string"), J.none_of(J.ERROR))).otherwise(got)
            out = F.when(k == name, got) if out is None else out.when(k == name, got)
        for patterns, child in node.matched():
            hit, got = matches(k, patterns), self.value(child, v, path)
            out = F.when(hit, got) if out is None else out.when(hit, got)
        return plain if out is None else out.otherwise(plain)

    def _object(self, node: Node, members: Column, spread: list[str], path: str) -> Column:
        def put(done: Column) -> Column:
            errors = F.flatten(done["e"])
            if not spread:
                return self.result(J.members_text(members["key"], done["j"]), errors)
            own = F.zip_with(members["key"], done["j"], lambda k, j: F.struct(k.alias("k"), j.alias("j")))
            name = spread[-1]
            given_back = F.zip_with(members["key"], done["x"], lambda k, x: F.when(k == name, x))
            more = F.coalesce(F.get(F.filter(given_back, lambda x: x.isNotNull()), F.lit(0)), J.none_of(self.MEMBER))
            some = F.exists(given_back, lambda x: x.isNotNull())

            def merge(given: Column) -> Column:
                names = F.transform(given, lambda m: m["k"])
                rest = F.filter(own, lambda m: (~some | (m["k"] != name)) & ~F.array_contains(names, m["k"]))
                return F.array_sort(F.concat(rest, given))

            return J.let(J.let(more, merge), lambda all_: self.result(J.object_text(all_), errors, all_))

        return J.let(F.transform(members, lambda m: self._member(node, m["key"], m["value"], path)), put)

    def _array(self, node: Node, items: Column, path: str) -> Column:
        def one(v: Column, i: Column) -> Column:
            out = None
            for place, child in node.places.items():
                got = self.value(child, v, f"{path}/{place}")
                out = F.when(i == place, got) if out is None else out.when(i == place, got)
            rest = self.value(node.items, v, f"{path}/*") if node.items else self.result(J.text(v), J.none_of(J.ERROR))
            return rest if out is None else out.otherwise(rest)

        return J.let(F.transform(items, one), lambda done: self.result(J.array_text(done), F.flatten(done["e"])))

    def _map(self, node: Node, items: Column, path: str) -> Column:
        """Pairs to members, if all are pairs. Of equal keys the last counts."""
        key = next(t["keyField"] for t in node.own if t["type"] == "map_to_array")
        child = node.items.members.get("value", Node()) if node.items else Node()
        pairs = F.transform(items, lambda v: J.let(J.as_map(v), lambda m: F.struct(J.string(m[key]).alias("k"), m["value"].alias("v"), F.coalesce(F.map_contains_key(m, "value"), F.lit(False)).alias("has"))))

        def restored(all_: Column) -> Column:
            each = F.transform(all_, lambda p, i: J.let(self.value(child, p["v"], f"{path}/*"), lambda r: F.struct(p["k"].alias("k"), i.alias("i"), r["j"].alias("j"), r["e"].alias("e"))))
            in_order = lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["k"] != p["k"], F.lit(True)))

            def put(s: Column) -> Column:
                members = F.transform(s, lambda p: F.struct(p["k"].alias("k"), p["j"].alias("j")))
                return self.result(J.object_text(s), F.flatten(s["e"]), members)

            return J.let(F.sort_array(each), lambda s: J.let(in_order(s), put))

        ok = lambda all_: F.forall(all_, lambda p: p["has"] & p["k"].isNotNull())
        return J.let(pairs, lambda all_: F.when(ok(all_), restored(all_)).otherwise(self._array(Node(items=node.items), items, path)))


# -- second and third step: types and constraints --------------------------------------------------------------------

ENFORCED = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "maxLength", "maxItems")
CHECKED = (*ENFORCED, "minLength", "minItems", "pattern")
EPSILON = 2.0**-52


def warning(path: Column, schema_path: Column | str, constraint: str, message: Column, kind: str = "constraint_violation") -> Column:
    where = F.when(path == "", "/").otherwise(path)
    schema_path = F.lit(schema_path) if isinstance(schema_path, str) else schema_path
    return F.struct(
        where.alias("dataPath"), schema_path.alias("schemaPath"), F.struct(F.lit(kind).alias("type"), F.lit(constraint).alias("constraint")).alias("kind"), message.alias("message")
    )


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _count(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def _long(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63


class Settle:
    """Compiles coercion, enforcement and checks. A value becomes j and the warnings a, b, c of the three."""

    def __init__(self, codec: Codec) -> None:
        self.root = Node()
        self.general: list[Column] = []
        whole = F.lit("")
        for d in codec.dropped:
            if d["constraint"] == "pattern" and not (isinstance(d["value"], str) and usable(d["value"])):
                why = f"constraint 'pattern' value ({text_of(d['value'])}) is not a string and cannot be validated" if not isinstance(d["value"], str) else f"pattern {json.dumps(d['value'])} cannot be evaluated"
                self.general.append(warning(whole, d["path"], "pattern", F.lit(why), "constraint_unevaluable"))
        for n, d in enumerate(codec.dropped):
            if d["constraint"] in CONDITIONS:
                why = f"constraint '{d['constraint']}' was dropped during compilation and cannot be validated"
                self.general.append(warning(whole, d["path"], d["constraint"], F.lit(why), "constraint_unevaluable"))
            elif d["constraint"] in CHECKED and (node := self.root.at(split(d["path"]))) is not None:
                if d["constraint"] != "pattern" or isinstance(d["value"], str) and usable(d["value"]):
                    node.own.append({**d, "at": n})

    def result(self, j: Column, *groups: Column) -> Column:
        return F.struct(j.alias("j"), *(g.cast(f"array<{J.WARNING}>").alias(n) for g, n in zip(groups, "abc", strict=True)))

    # A schema is None where coercion doesn't follow.
    def value(self, node: Node | None, schema, v: Column, path: Column) -> Column:
        node = node or Node()
        schema = schema if isinstance(schema, dict) else {}
        kinds = schema.get("type")
        kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds if isinstance(k, str)] if isinstance(kinds, list) else []
        if not node.own and node.bare and not schema.keys() & {"type", "properties", "items", "prefixItems", "anyOf", "oneOf"}:
            nothing = J.none_of(J.WARNING)
            return self.result(J.text(v), nothing, nothing, nothing)
        nothing = J.none_of(J.WARNING)
        if not node.own and node.bare and not schema.keys() & {"properties", "items", "prefixItems", "anyOf", "oneOf"}:

            def leaf(to: str, value: Column, told: Column) -> Column:
                return self.result(J.number_text(value) if to == "number" else J.quoted(value) if to == "string" else value.cast("string"), told, nothing, nothing)

            return J.let(J.kind(v), lambda k: self._coerced(v, k, kinds, path, self.result(self._text(v, k), nothing, nothing, nothing), leaf))

        def state(to: str, value: Column, told: Column) -> Column:
            return F.struct(value.cast("variant").alias("v"), F.lit(to).alias("k"), told.alias("a"))

        same = lambda k: F.struct(v.alias("v"), k.alias("k"), nothing.alias("a"))
        return J.let(J.let(J.kind(v), lambda k: self._coerced(v, k, kinds, path, same(k), state)), lambda s: self._typed(node, schema, s, path))

    @staticmethod
    def _text(v: Column, kind: Column) -> Column:
        """A double is written as one; other values as they came."""
        return F.when((kind == "number") & (F.schema_of_variant(v) == "DOUBLE"), J.number_text(F.try_variant_get(v, "$", "double"))).otherwise(J.text(v))

    def _coerced(self, v: Column, kind: Column, kinds: list[str], path: Column, same: Column, make) -> Column:
        """make(kind, value, warnings) of v as one of the kinds if it can be, else what stands for v itself."""
        if not set(kinds) & {"string", "integer", "number", "boolean"}:
            return same

        def made(to: str, value: Column, message: Column) -> Column:
            return make(to, value, F.array(warning(path, path, "type", message)).cast(f"array<{J.WARNING}>"))

        def choose(s: Column) -> Column:
            shown = J.text(v)
            d = F.try_variant_get(v, "$", "double")
            out = F.when(F.lit(False), same)
            for k in kinds:
                if k == "string":
                    number = F.when(kind == "number", J.number_text(d)).otherwise(shown)
                    out = out.when(kind.isin("integer", "number"), made(k, number, F.concat(F.lit("coerced number "), number, F.lit(' to string "'), number, F.lit('"'))))
                    out = out.when(kind == "boolean", made(k, shown, F.concat(F.lit("coerced boolean "), shown, F.lit(' to string "'), shown, F.lit('"'))))
                elif k == "integer":
                    n = F.try_variant_get(v, "$", "bigint")
                    out = out.when((kind == "string") & s.rlike("^(0|-?[1-9][0-9]*)$") & n.isNotNull(), made(k, n, F.concat(F.lit('coerced string "'), s, F.lit('" to integer '), s)))
                elif k == "number":
                    grammar = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
                    n = s.try_cast("double")
                    good = (kind == "string") & s.rlike(grammar) & n.isNotNull() & (F.abs(n) < float("inf"))
                    out = out.when(good, made(k, n, F.concat(F.lit('coerced string "'), s, F.lit('" to number '), J.short_number(n))))
                elif k == "boolean":
                    out = out.when((kind == "string") & s.isin("true", "false"), made(k, s == "true", F.concat(F.lit('coerced string "'), s, F.lit('" to boolean '), s)))
            return out.otherwise(same)

        fits = kind.isin("object", "array", "null", *kinds, *(["integer"] if "number" in kinds else []))
        return F.when(fits, same).otherwise(J.let(F.when(kind == "string", F.try_variant_get(v, "$", "string")), choose))

    def _typed(self, node: Node, schema: dict, s: Column, path: Column) -> Column:
        unions = [(w, u) for w in ("anyOf", "oneOf") if isinstance(u := schema.get(w), list)]
        if not unions:
            return self._bounded(node, schema, s, path)
        plain = {k: x for k, x in schema.items() if k not in ("anyOf", "oneOf")}
        out = None
        for _, variants in unions[:1]:
            for variant in variants:
                kinds = variant.get("type") if isinstance(variant, dict) else None
                kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
                kinds = [k for k in kinds if isinstance(k, str)]
                if not kinds:
                    continue
                hit = s["k"].isin(*kinds, *(["integer"] if "number" in kinds else []))
                one = {**plain, **variant, "properties": {**plain.get("properties", {}), **variant.get("properties", {})}} if plain.get("properties") else {**plain, **variant}
                more = {k: x for k, x in one.items() if k != "type"}
                got = self._typed(node, more, s, path) if isinstance(one.get("anyOf") or one.get("oneOf"), list) else self._bounded(node, more, s, path)
                out = F.when(hit, got) if out is None else out.when(hit, got)
        rest = self._bounded(node, plain, s, path)
        return rest if out is None else out.otherwise(rest)

    def _bounded(self, node: Node, schema: dict, given: Column, path: Column) -> Column:
        """Bounds enforced at this value, in the codec's order, then what is inside, then the checks of this value."""
        bounds = [d for d in node.own if d["constraint"] in ENFORCED]

        def checked(s: Column) -> Column:
            inside = self._inside(node, schema, s["v"], s["k"], path)
            if not node.own:
                return J.let(inside, lambda r: self.result(r["j"], F.concat(given["a"], r["a"]), r["b"], r["c"]))
            checks = F.filter(F.array(*(self._check(s["v"], s["k"], d, path) for d in node.own)), lambda w: w.isNotNull()).cast(f"array<{J.WARNING}>")
            return J.let(inside, lambda r: self.result(r["j"], F.concat(given["a"], r["a"]), F.concat(s["b"], r["b"]), F.concat(checks, r["c"])))

        if not bounds:
            return checked(given) if not node.own else J.let(F.struct(given["v"].alias("v"), given["k"].alias("k"), J.none_of(J.WARNING).alias("b")), checked)
        state = F.struct(given["v"].alias("v"), given["k"].alias("k"), J.none_of(J.WARNING).alias("b"))
        for d in bounds:
            state = J.let(state, lambda s, d=d: self._enforced(s, d, path))
        return J.let(state, checked)

    def _enforced(self, s: Column, d: dict, path: Column) -> Column:
        v, k, word, bound = s["v"], s["k"], d["constraint"], d["value"]
        told = lambda m: F.array_append(s["b"], warning(path, d["path"], word, m).cast(J.WARNING))
        if word in ("maxLength", "maxItems"):
            if not _count(bound):
                return s
            text, items = F.when(k == "string", F.try_variant_get(v, "$", "string")), F.when(k == "array", J.as_array(v))
            size = F.char_length(text) if word == "maxLength" else F.size(items)
            cut = F.left(text, F.lit(bound)).cast("variant") if word == "maxLength" else F.try_parse_json(J.array_text(F.transform(F.slice(items, 1, bound), lambda x: F.struct(J.text(x).alias("j")))))
            what = "string" if word == "maxLength" else "array"
            over = (text if word == "maxLength" else items).isNotNull() & (size > bound)
            message = F.concat(F.lit(f"{what} length "), size.cast("string"), F.lit(f" exceeded {word} {bound}; truncated"))
            return F.when(over, F.struct(cut.alias("v"), k.alias("k"), told(message).alias("b"))).otherwise(s)
        if not _number(bound):
            return s
        d_value = F.when(k.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        limit, shown = F.lit(float(bound)), J.short_number(F.lit(float(bound)))
        step = {"exclusiveMinimum": 1, "exclusiveMaximum": -1}.get(word, 0)
        over = {"minimum": d_value < limit, "maximum": d_value > limit, "exclusiveMinimum": d_value <= limit, "exclusiveMaximum": d_value >= limit}[word]
        if _long(bound) and _long(bound + step):
            to, kind = F.lit(bound + step).cast("bigint").cast("variant"), "integer"
        else:
            to, kind = F.lit(float(bound) + step * EPSILON).cast("double").cast("variant"), "number"
        says = {"minimum": "below minimum", "maximum": "exceeded maximum", "exclusiveMinimum": "not greater than exclusive minimum", "exclusiveMaximum": "not less than exclusive maximum"}[word]
        message = F.concat(F.lit("value "), J.short_number(d_value), F.lit(f" {says} "), shown, F.lit("; clamped"))
        return F.when(over, F.struct(to.alias("v"), F.lit(kind).alias("k"), told(message).alias("b"))).otherwise(s)

    def _check(self, v: Column, kind: Column, d: dict, path: Column) -> Column:
        word, bound = d["constraint"], d["value"]
        never = F.lit(None).cast(J.WARNING)
        told = lambda bad, m: F.when(bad, warning(path, d["path"], word, m).cast(J.WARNING))
        if word == "pattern":
            s = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
            return told(~s.rlike(java_pattern(bound)), F.concat(F.lit("value "), J.quoted(s), F.lit(f" does not match pattern {json.dumps(bound, ensure_ascii=False)}")))
        if word in ("minLength", "maxLength", "minItems", "maxItems"):
            if not _count(bound):
                return never
            size = F.when(kind == "string", F.char_length(F.try_variant_get(v, "$", "string"))) if word.endswith("Length") else F.when(kind == "array", F.size(J.as_array(v)))
            bad, says = (size < bound, "is less than") if word.startswith("min") else (size > bound, "exceeds")
            return told(bad, F.concat(F.lit(f"{'string' if word.endswith('Length') else 'array'} length "), size.cast("string"), F.lit(f" {says} {word} {bound}")))
        if not _number(bound):
            return never
        d_value = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        shown = F.when(kind == "integer", J.text(v)).otherwise(J.short_number(d_value))
        n, exact = F.when(kind == "integer", F.try_variant_get(v, "$", "decimal(38,0)")), F.lit(bound).cast("decimal(38,0)") if isinstance(bound, int) and abs(bound) < 10**37 else None

        def compare(how) -> Column:
            loose = how(d_value, F.lit(float(bound)))
            return loose if exact is None else F.when(n.isNotNull(), how(n, exact)).otherwise(loose)

        bad, says = {
            "minimum": (lambda x, y: x < y, "is less than minimum"), "maximum": (lambda x, y: x > y, "exceeds maximum"),
            "exclusiveMinimum": (lambda x, y: x <= y, "is not greater than exclusive minimum"), "exclusiveMaximum": (lambda x, y: x >= y, "is not less than exclusive maximum"),
        }[word]
        return told(compare(bad), F.concat(F.lit("value "), shown, F.lit(f" {says} "), J.short_number(F.lit(float(bound)))))

    def _inside(self, node: Node, schema: dict, v: Column, kind: Column, path: Column) -> Column:
        nothing = J.none_of(J.WARNING)
        fields = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        prefix = schema.get("prefixItems") if isinstance(schema.get("prefixItems"), list) else []
        items = schema.get("items")
        leaf = self.result(self._text(v, kind), nothing, nothing, nothing)
        out = None
        if fields or node.members or node.patterns:
            out = F.when(kind == "object", J.let(F.map_entries(J.as_map(v)), lambda m: self._object(node, fields, m, path)))
        if prefix or isinstance(items, dict) or node.items or node.places:
            array = J.let(J.as_array(v), lambda x: self._array(node, prefix, items, x, path))
            out = F.when(kind == "array", array) if out is None else out.when(kind == "array", array)
        return leaf if out is None else out.otherwise(leaf)

    def _object(self, node: Node, fields: dict, members: Column, path: Column) -> Column:
        names = sorted(fields.keys() | node.members.keys())

        def one(m: Column) -> Column:
            below = F.concat(path, F.lit("/"), J.escaped(m["key"]))
            nothing = J.none_of(J.WARNING)
            out = None
            for name in names:
                got = self.value(node.named(name), fields.get(name), m["value"], below)
                out = F.when(m["key"] == name, got) if out is None else out.when(m["key"] == name, got)
            for patterns, child in node.matched():
                hit, got = matches(m["key"], patterns), self.value(child, None, m["value"], below)
                out = F.when(hit, got) if out is None else out.when(hit, got)
            plain = self.result(J.text(m["value"]), nothing, nothing, nothing)
            return plain if out is None else out.otherwise(plain)

        return J.let(F.transform(members, one), lambda done: self.result(J.members_text(members["key"], done["j"]), *(F.flatten(done[g]) for g in "abc")))

    def _array(self, node: Node, prefix: list, items, values: Column, path: Column) -> Column:
        places = sorted({*range(len(prefix)), *node.places})

        def one(v: Column, i: Column) -> Column:
            below = F.concat(path, F.lit("/"), i.cast("string"))
            out = None
            for place in places:
                got = self.value(node.places.get(place) or node.items, prefix[place] if place < len(prefix) else items, v, below)
                out = F.when(i == place, got) if out is None else out.when(i == place, got)
            rest = self.value(node.items, items, v, below)
            return rest if out is None else out.otherwise(rest)

        return J.let(F.transform(values, one), lambda done: self.result(J.array_text(done), *(F.flatten(done[g]) for g in "abc")))


# -- the whole -------------------------------------------------------------------------------------------------------

MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")


def undo(document: Column, codec: Codec | dict | str) -> Column:
    """struct(j, e) of a document as VARIANT: the transforms undone, and errors."""
    return Undo().value(_tree(Codec.of(codec)), document)


def settle(document: Column, codec: Codec | dict | str, original) -> Column:
    """struct(j, w) of a document as VARIANT: types and constraints settled, and all warnings."""
    steps = Settle(Codec.of(codec))
    got = steps.value(steps.root, ordered(parsed(original)), document, F.lit(""))
    general = F.array(*steps.general).cast(f"array<{J.WARNING}>") if steps.general else J.none_of(J.WARNING)
    return J.let(got, lambda r: F.struct(r["j"].alias("j"), F.concat(r["a"], r["b"], general, r["c"]).alias("w")))


def rehydrate(
    df: DataFrame, codec: Codec | dict | str, original, column: str = "document", data: str = "data", warnings: str = "warnings", error: str = "error", mode: str = "PERMISSIVE", lenient: bool = True
) -> DataFrame:
    """Adds the document in its original shape as JSON text, an array of warnings, and an error or NULL.

    A lenient reading leaves out what follows the first JSON value of a document.
    PERMISSIVE keeps what can't be undone as it is and tells why; FAILFAST stops the job; DROPMALFORMED drops the row.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    with _deep_plans(df):
        return _rehydrate(df, Codec.of(codec), original, column, data, warnings, error, mode, lenient)


@contextmanager
def _deep_plans(df: DataFrame):
    """Each level of a document is a level of lambdas, which the analyser resolves one after the other."""
    conf, name = df.sparkSession.conf, "spark.sql.analyzer.maxIterations"
    before = conf.get(name)
    conf.set(name, str(max(int(before), 1000)))
    try:
        yield
    finally:
        conf.set(name, before)


def _rehydrate(df: DataFrame, codec: Codec, original, column: str, data: str, warnings: str, error: str, mode: str, lenient: bool) -> DataFrame:
    raw = F.col(column)
    bad = F.struct(F.lit("json_parse_error").alias("code"), F.concat(F.lit("the document is not JSON: "), F.left(raw, F.lit(100))).alias("message"), F.lit("/").alias("path"))
    step = df.withColumn("__v", F.try_parse_json(raw) if lenient else J.strict_parse(raw))
    unread = F.when(raw.isNotNull() & F.col("__v").isNull(), bad.cast(J.ERROR))
    if _changes(_tree(codec)):
        step = step.withColumn("__u", F.when(F.col("__v").isNotNull(), undo(F.col("__v"), codec)))
        step = step.withColumn(error, unread.otherwise(F.get(F.col("__u.e"), F.lit(0)))).withColumn("__w", F.try_parse_json(F.col("__u.j")))
    else:  # nothing to undo: the document is settled as it was read
        step = step.withColumn(error, unread).withColumn("__w", F.col("__v"))
    if mode == "FAILFAST":
        step = step.withColumn("__w", F.when(F.col(error).isNull(), F.col("__w")).otherwise(F.raise_error(F.col(f"{error}.message")).cast("variant")))
    if mode == "DROPMALFORMED":
        step = step.filter(F.col(error).isNull())
    step = step.withColumn("__s", F.when(F.col("__w").isNotNull(), settle(F.col("__w"), codec, original)))
    return step.withColumn(data, F.col("__s.j")).withColumn(warnings, F.coalesce(F.col("__s.w"), J.none_of(J.WARNING))).drop("__v", "__u", "__w", "__s")
