"""JSON files in and out, through Spark's readers and writers, so that any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import ATTEMPT
from ..plans.codec import Codec
from ..plans.convert import parsed

MANIFEST = "title string, generated_at string, components array<struct<name string, pointer string, schemaPath string, codecPath string, originalPath string, dependencyCount bigint>>"
RESULT = f"struct<file string, verdict string, classification string, attempts array<{ATTEMPT}>>"
REPORT = f"detailed_results array<{RESULT}>"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """path and text of whole files, by name."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_schemas(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """name and schema of all JSON files of a folder."""
    files = read_texts(spark, path, recursive=recursive)
    return files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), F.col("text").alias("schema"))


def read_schema(spark: SparkSession, path: str):
    """One schema, on the driver. Schemas are small."""
    return parsed(read_texts(spark, path, "*").first()["text"])


def read_codec(spark: SparkSession, path: str) -> Codec:
    return Codec.of(read_texts(spark, path, "*").first()["text"])


def read_documents(spark: SparkSession, path: str, lenient: bool = True) -> DataFrame:
    """path and document of model outputs, a file each. Lenient: what follows the first JSON value is left out."""
    files = read_texts(spark, path, "*")
    first = F.when(F.try_parse_json("text").isNotNull(), F.col("text") if not lenient else F.to_json(F.try_parse_json("text")))
    return files.select("path", F.coalesce(first, F.col("text")).alias("document"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """document: a JSON value a line."""
    return spark.read.text(path).select(F.col("value").alias("document"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return found.select(F.inline("components"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Verdict rows of a run's report."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.inline("detailed_results"))


def write_json(df: DataFrame, path: str, column: str, pretty: bool = False, mode: str = "errorifexists") -> None:
    """A JSON text a row, compact; or pretty, for people."""
    value = F.to_json(F.try_parse_json(column), {"pretty": "true"}) if pretty else F.col(column)
    df.select(value.alias("value")).write.mode(mode).text(path)


def pointer_folder(pointer: Column) -> Column:
    """A folder for a pointer. Empty and dotted segments are left out, so that no path leads upwards."""
    parts = F.split(F.regexp_replace(pointer, "^#", ""), "/")
    return F.array_join(F.filter(parts, lambda s: ~s.isin("", ".", "..")), "/")


def write_components(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of converted components, a partition a folder of its pointer."""
    folder = F.when(F.col("pointer") == "#", "_root").otherwise(F.regexp_replace(pointer_folder(F.col("pointer")), "/", "."))
    df.withColumn("component", folder).write.mode(mode).partitionBy("component").parquet(path)


def write_component_files(df: DataFrame, path: str, title: str = "", mode: str = "errorifexists") -> None:
    """The converted components of one schema as JSON files: schema, codec and original of each, and a manifest.

    A component's files lie in components/component=.../file=...; the manifest names them, and `read_manifest` reads it.
    Components without a plan are left out.
    """
    folder = F.when(F.col("pointer") == "#", "_root").otherwise(F.regexp_replace(F.regexp_replace("pointer", "^#/", ""), "[^A-Za-z0-9_-]", "."))
    planned = df.filter("converted IS NOT NULL").withColumn("component", folder)
    files = {"schema": "converted", "codec": "codec", "original": "original"}
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("file"), F.col(c).alias("value")) for f, c in files.items())))
    planned.select("component", each).write.mode(mode).partitionBy("component", "file").text(f"{path}/components")
    place = lambda f: F.concat(F.lit("components/component="), F.col("component"), F.lit(f"/file={f}"))
    entry = F.struct(
        F.col("component").alias("name"), "pointer", place("schema").alias("schemaPath"), place("codec").alias("codecPath"), place("original").alias("originalPath"),
        F.col("dependency_count").cast("bigint").alias("dependencyCount"),
    )
    listed = planned.agg(F.array_sort(F.collect_list(entry)).alias("components"))  # the components of one schema
    told = F.struct(F.lit(title).alias("title"), F.current_timestamp().cast("string").alias("generated_at"), "components")
    listed.select(F.to_json(told).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/manifest")
