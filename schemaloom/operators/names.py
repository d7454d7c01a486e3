"""Identifiers for components: made safe, in the usual cases, and told apart where they clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import numbered

#: The columns that `resolved` adds, and the case of each.
FORMS = {"class_name": "upper_camel", "enum_name": "shouty", "module_name": "snake", "module_name_camel": "lower_camel"}


def sanitised(name: Column) -> Column:
    """Letters and digits of ASCII, anything else an underscore; one stands before a first digit; never empty."""
    safe = F.concat(F.when(name.rlike("^[0-9]"), "_").otherwise(""), F.regexp_replace(name, "[^A-Za-z0-9]", "_"))
    return F.when(name == "", "_empty").otherwise(safe)


def words(name: Column) -> Column:
    """Words in lower case. One ends at an underscore, before a capital after small letters, and before the last of
    several capitals if a small letter follows it; digits belong to what stands before them."""
    cut = F.regexp_replace(name, "([a-z][0-9]*)([A-Z])", "$1_$2")
    cut = F.regexp_replace(cut, "([A-Z][0-9]*)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), "_"), lambda w: w != "")


def cased(found: Column, form: str) -> Column:
    """Words as one name: snake, shouty, upper_camel or lower_camel."""
    if form in ("snake", "shouty"):
        joined = F.array_join(found, "_")
        return joined if form == "snake" else F.upper(joined)
    large = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(found, lambda w, i: large(w) if form == "upper_camel" else F.when(i == 0, w).otherwise(large(w))), "")


def resolved(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds a class, an enum and two module names; clashes in each case are numbered in the order of rows."""
    for column, form in FORMS.items():
        df = numbered(df.withColumn("__form", cased(words(sanitised(F.col(name))), form)), "__form", order, column).drop("__form")
    return df
