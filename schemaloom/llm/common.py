"""What the operators of this package share: paths, row identity and small packing helpers."""

from __future__ import annotations

import contextlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

#: The white space between words: blank and bytes 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch: what a plan has shuffled goes when its execution ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """Plans made in here drop their shuffle files when they have run: what they wrote is in the shared folder by then."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: compressed, and read by column. It goes when the driver ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    with _shuffles_end(spark):
        df.select("*").write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


#: Bits of a key filter: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of hashes of the keys, in at most bits / 32768 rows of 4 KB: small enough to broadcast at any scale."""
    place = F.pmod(F.xxhash64(F.lit(17), key), F.lit(bits)) + 1
    found = keys.select(place.alias("p"))
    return found.groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))


def may_hold(df: DataFrame, key: str, table: DataFrame, bits: int = FILTER_BITS, flag: str = "__may") -> DataFrame:
    """Adds whether a row's key may be among the filter's keys: true for all that are, and for a few others.

    It spares a shuffle most of the rows that would find no partner; a full filter spares nothing and loses nothing.
    """
    place = F.pmod(F.xxhash64(F.lit(17), key), F.lit(bits)) + 1
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int"))
    joined = df.withColumn("__p", place).withColumn("__b", F.bitmap_bucket_number("__p")).join(F.broadcast(table), F.col("__b") == F.col("__bucket"), "left")
    return joined.withColumn(flag, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("__p", "__b", "__bucket", "__bits")


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text: the fixed split of documents into folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart when ids repeat: rows with equal id and text have equal results."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
