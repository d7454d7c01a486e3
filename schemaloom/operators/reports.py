"""Runs over many schemas: verdicts, rates, and two runs held against each other.

Verdict rows: file, verdict, classification, attempts array<struct<passed, stage, reason, error>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPT = "struct<passed boolean, stage string, reason string, error string>"
# Verdicts that count as a pass, and the names of transitions.
PASSING = ("solid_pass", "flaky_pass", "unexpected_pass")
EXPECTED = "expected_fail"
REGRESSIONS = ("new_failure",)


def base_name(file: Column) -> Column:
    return F.regexp_replace(file, r"(?<=[^/.])\.[^./]*$", "")


def verdict(attempts: Column) -> Column:
    """solid_pass if the first attempt passed, flaky_pass if a later one did, else solid_fail."""
    passed = lambda a: F.coalesce(a["passed"], F.lit(False))
    return (
        F.when(F.coalesce(F.get(attempts, F.lit(0))["passed"], F.lit(False)), "solid_pass")
        .when(F.exists(attempts, passed), "flaky_pass")
        .otherwise("solid_fail")
    )


def last_stage(attempts: Column) -> Column:
    return F.coalesce(F.try_element_at(attempts, F.lit(-1))["stage"], F.lit("unknown"))


def verdicts(df: DataFrame) -> DataFrame:
    """name and verdict of each schema: its classification, or else its verdict. Rows without a file go."""
    return df.filter(F.coalesce(F.col("file"), F.lit("")) != "").select(base_name(F.col("file")).alias("name"), F.coalesce("classification", "verdict").alias("verdict"))


def pass_rate(df: DataFrame, *by: str, name: str = "pass_rate") -> DataFrame:
    """Per cent of passes; schemas that are expected to fail don't count. 0 where nothing counts."""
    counted = F.coalesce(F.col("verdict"), F.lit("")) != EXPECTED
    rate = 100.0 * F.count(F.when(counted & F.col("verdict").isin(*PASSING), 1)) / F.nullif(F.count(F.when(counted, 1)), F.lit(0))
    return df.groupBy(*by).agg(F.coalesce(rate, F.lit(0.0)).alias(name))


def classify(df: DataFrame, expected: DataFrame, config_rows: int = 100_000) -> DataFrame:
    """Adds the classification: verdicts seen against a table (name, stage) of expected failures.

    A name that is expected more than once counts once, with the least of its stages. The table is broadcast if it is
    counted to be small; otherwise both are joined by name.
    """
    known = expected.groupBy(F.col("name").alias("__n")).agg(F.min("stage").alias("__s")).withColumn("__known", F.lit(True))
    if known.limit(config_rows + 1).count() <= config_rows:
        known = F.broadcast(known)
    joined = df.join(known, base_name(F.col("file")) == F.col("__n"), "left")
    stage = F.try_element_at(F.col("attempts"), F.lit(-1))["stage"]
    wrong = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(stage)
    out = (
        F.when(F.col("__known").isNull(), F.col("verdict"))
        .when(F.col("verdict").isin("solid_pass", "flaky_pass"), "unexpected_pass")
        .when(wrong, "solid_fail")
        .otherwise(EXPECTED)
    )
    return joined.withColumn("classification", out).drop("__n", "__s", "__known")


def transition(old: Column, new: Column) -> Column:
    """What became of a schema that is in both runs; the first that fits."""
    passes = lambda v: F.coalesce(v.isin(*PASSING), F.lit(False))
    is_ = lambda v, name: F.coalesce(v == name, F.lit(False))
    return (
        F.when(old.eqNullSafe(new), "unchanged")
        .when(is_(old, EXPECTED) & passes(new), "fix")
        .when(is_(old, "unexpected_pass") & is_(new, "solid_pass"), "config_drift")
        .when(is_(old, "solid_pass") & is_(new, "flaky_pass"), "new_flaky")
        .when(passes(old) & ~passes(new), "new_failure")
        .when(~passes(old) & passes(new), "new_pass")
        .otherwise("other")
    )


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """name, baseline, current, transition over all schemas of two runs (name, verdict)."""
    b = baseline.select("name", F.col("verdict").alias("baseline"), F.lit(True).alias("__b"))
    c = current.select("name", F.col("verdict").alias("current"), F.lit(True).alias("__c"))
    kind = F.when(F.col("__c").isNull(), "removed").when(F.col("__b").isNull(), "added").otherwise(transition(F.col("baseline"), F.col("current")))
    return b.join(c, "name", "full_outer").select("name", "baseline", "current", kind.alias("transition"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of a run that the other hasn't."""
    return left.select("name").join(right.select("name"), "name", "left_anti").distinct()


def regressed(compared: DataFrame, strict: bool = False) -> DataFrame:
    """One row: whether a schema fails that passed; strict counts new flakiness too."""
    bad = (*REGRESSIONS, *(("new_flaky",) if strict else ()))
    return compared.agg((F.count(F.when(F.col("transition").isin(*bad), 1)) > 0).alias("regressed"))


def failures_by_stage(df: DataFrame) -> DataFrame:
    failed = df.filter(F.coalesce("classification", "verdict") == "solid_fail")
    return failed.groupBy(last_stage(F.col("attempts")).alias("stage")).agg(F.count("*").alias("n")).orderBy("stage")


def numbered(df: DataFrame, name: str, order: str, column: str = "unique_name") -> DataFrame:
    """Names that clash, whatever their case, get a number in the order of rows: a, a_2, a_3.

    A name that is given so is taken from then on: after a, a comes a_2, and a row that is called a_2 itself becomes
    a_2_2. As in the original, a count starts anew from one whenever its name is given to another. So counts of a_2
    depend on those of a, and those of a_2_2 on a_2: names are numbered by how many numbers they end in, a window for
    each. A name without clashes or numbers costs one window; a window over one name streams its rows.
    """
    key = F.lower(F.col(name))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(name).alias("name"), F.col(order).alias("o"), key.alias("k"))
    rows = rows.withColumn("level", F.coalesce(F.size(F.split(F.regexp_extract("k", r"((?:_[0-9]+)*)$", 1), "_")) - 1, F.lit(0)))
    levels = [r[0] for r in rows.select("level").distinct().orderBy("level").collect()]  # as many as numbers at the end of a name
    parts, given = [], None
    for level in range(max(levels, default=0) + 1):
        own = rows.filter(F.col("level") == level).select("row", "name", "o", "k", F.lit(1).alias("own"))
        if given is not None:
            taken = given.join(own.select("k").distinct(), "k", "left_semi")
            own = own.unionByName(taken.select("k", "o", F.lit(0).alias("own")), allowMissingColumns=True)
        in_order = Window.partitionBy("k").orderBy("o", "name")
        marked = own.withColumn("since", F.sum(1 - F.col("own")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        within = Window.partitionBy("k", "since").orderBy("o", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = marked.withColumn("n", F.sum("own").over(within) + (F.col("since") > 0).cast("int")).filter("own = 1")
        parts.append(counted.select("row", "name", "n"))
        given = counted.filter("n > 1").select(F.concat("k", F.lit("_"), F.col("n").cast("string")).alias("k"), "o")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    unique = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string")))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c != column), F.when(F.col("name").isNotNull(), unique).alias(column))


def chosen(df: DataFrame, name: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name).cast("string"))), name).limit(n)


def timing(df: DataFrame, name: str, value: str, *by: str) -> DataFrame:
    """Mean, and the fastest and slowest with their names."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.min(F.struct(F.col(value), F.col(name)))[name].alias("fastest"), F.max(F.struct(F.col(value), F.col(name)))[name].alias("slowest"),
    )
