"""SQL functions over JSON text: conversion, components, patches and the strict audit.

Rehydration is no SQL function: a codec is compiled to column expressions, so `operators.rehydrate.rehydrate` takes it
as a constant and a view of its result serves SQL.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from ..plans.audit import violations
from ..plans.components import convert_all, extract_component, list_components
from ..plans.convert import convert
from ..plans.describe import text_of
from ..plans.errors import PlanError
from ..plans.patch import apply_patch


def _told(make) -> str:
    """The JSON text of a result, or of its error: {"error": {code, message, path}}."""
    try:
        return text_of(make())
    except PlanError as e:
        return text_of({"error": e.as_dict()})


def _all(schema: str, options: dict | None) -> dict:
    """The whole schema's plan and those of its components; an error stands in its component's place."""
    full, parts = convert_all(schema, options)
    each = [{"pointer": c.pointer, "error": c.error} if c.plan is None else {"pointer": c.pointer, **c.plan.as_dict()} for c in parts]
    return {"full": full.as_dict(), "components": each}


def register(spark: SparkSession) -> list[str]:
    @pandas_udf("string")
    def convert_schema(schema: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _told(lambda s=s, o=o: convert(s, json.loads(o) if o else None).as_dict()) for s, o in zip(schema, options, strict=True)], dtype=object)

    @pandas_udf("array<string>")
    def schema_components(schema: pd.Series) -> pd.Series:
        return schema.map(lambda s: None if s is None else list_components(s))

    @pandas_udf("string")
    def schema_component(schema: pd.Series, pointer: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or p is None else _told(lambda s=s, p=p: vars(extract_component(s, p))) for s, p in zip(schema, pointer, strict=True)], dtype=object)

    @pandas_udf("string")
    def patch_schema(schema: pd.Series, patch: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or p is None else _told(lambda s=s, p=p: apply_patch(json.loads(s), json.loads(p))) for s, p in zip(schema, patch, strict=True)], dtype=object)

    @pandas_udf("array<struct<path string, rule_id string, message string>>")
    def strict_violations(schema: pd.Series) -> pd.Series:
        return schema.map(lambda s: None if s is None else [{"path": p, "rule_id": r, "message": m} for p, r, m in violations(json.loads(s))])

    @pandas_udf("string")
    def convert_components(schema: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _told(lambda s=s, o=o: _all(s, json.loads(o) if o else None)) for s, o in zip(schema, options, strict=True)], dtype=object)

    found = {"convert_schema": convert_schema, "convert_all_components": convert_components, "list_components": schema_components, "extract_component": schema_component, "patch_schema": patch_schema, "strict_violations": strict_violations}
    for name, function in found.items():
        spark.udf.register(name, function)
    return sorted(found)
