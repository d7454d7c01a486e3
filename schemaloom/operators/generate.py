"""The round trip: prompt, request, response, document in its original shape, and what is wrong with it.

All steps but the call itself are columns. A transport is the only Python on executors: a function from an iterator
of requests to an iterator of responses, made once a task, so that it can hold a client.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import json_text as J
from ..plans.convert import Plan, convert, parsed
from ..plans.options import Options
from ..plans.patch import apply_patch
from ..plans.validator import violations
from .providers import Endpoint, Wire
from .rehydrate import rehydrate

Request = dict  # url, headers, body
Transport = Callable[[Iterable[Request]], Iterator[str]]


class TransientError(Exception):
    """A transport raises this where trying again may help."""


def retrying(send: Callable[[Request], str], tries: int = 3, wait: float = 1.0, sleep=time.sleep, jitter=random.random) -> Transport:
    """A transport from a function of one request: waits twice as long after each transient failure, and a bit more."""

    def run(requests: Iterable[Request]) -> Iterator[str]:
        for request in requests:
            for attempt in range(tries):
                try:
                    yield send(request)
                    break
                except TransientError:
                    if attempt + 1 == tries:
                        raise
                    sleep(wait * 2**attempt * (1 + jitter()))

    return run


def call(df: DataFrame, transport: Callable[[], Transport], request: str = "request", response: str = "raw_response", failure: str = "transport_error") -> DataFrame:
    """Adds the responses, and why there is none. Whatever a transport raises fails one request; the job goes on.

    A transport is given all requests of a batch, so that it may send several at once. It answers in their order; if it
    raises, the first request without an answer has failed, and it is called again with those that follow.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(response, T.StringType()), T.StructField(failure, T.StringType())])

    def run(batches):
        send = transport()
        for batch in batches:
            todo = [{**r, "headers": dict(r["headers"] or [])} for r in batch[request].to_pylist()]
            out: list[tuple[str | None, str | None]] = []
            while len(out) < len(todo):
                try:
                    for answer in islice(send(todo[len(out) :]), len(todo) - len(out)):
                        out.append((answer, None))
                    if len(out) < len(todo):
                        out.append((None, "the transport gave no response"))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            columns = [pa.array([o[i] for o in out], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, response, failure])

    return df.mapInArrow(run, schema)


def requests(df: DataFrame, plan: Plan, wire: Wire, endpoint: Endpoint, prompt: str = "prompt") -> DataFrame:
    return df.withColumn("request", wire.request(F.col(prompt), plan.schema, endpoint))


def results(df: DataFrame, plan: Plan, wire: Wire, response: str = "raw_response", validate: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """From raw responses: content, data, warnings, error, validation_errors. No Python runs unless validate is set.

    Where there is a column transport_error, what it tells is the row's error.
    """
    out = df.withColumn("__x", wire.extract(F.col(response)))
    out = rehydrate(out.withColumn("content", F.col("__x.content")), plan.codec, plan.original, "content", mode=mode)
    parsing = F.struct(F.lit("response_parsing_error").alias("code"), F.col("__x.error").alias("message"), F.lit("/").alias("path")).cast(J.ERROR)
    out = out.withColumn("error", F.when(F.col("__x.error").isNotNull(), parsing).otherwise(F.col("error"))).drop("__x")
    if "transport_error" in df.columns:
        failed = F.struct(F.lit("transport_error").alias("code"), F.col("transport_error").alias("message"), F.lit("/").alias("path")).cast(J.ERROR)
        out = out.withColumn("error", F.when(F.col("transport_error").isNotNull(), failed).otherwise(F.col("error")))
    return validated(out, plan.original) if validate else out


def validated(df: DataFrame, schema, data: str = "data", column: str = "validation_errors") -> DataFrame:
    """Adds what a JSON Schema validator says of each document, as an array of texts."""
    rules = parsed(schema)

    @pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [f"{p}: {m}" for p, m in violations(json.loads(t), rules)])

    return df.withColumn(column, check(data))


def generate(
    df: DataFrame, schema, wire: Wire, endpoint: Endpoint, transport: Callable[[], Transport], options: dict | Options | None = None, patch: list[dict] | None = None, plan: Plan | None = None, prompt: str = "prompt"
) -> DataFrame:
    """The whole round trip. patch changes the schema first; a plan made before is used as it is."""
    if plan is None:
        schema = parsed(schema)
        plan = convert(apply_patch(schema, patch) if patch else schema, options)
    return results(call(requests(df, plan, wire, endpoint, prompt), transport), plan, wire)
