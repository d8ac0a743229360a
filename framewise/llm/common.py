"""Shared folders, table access and small column helpers of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The blanks that the contracts name: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_root: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local session without the setting gets a temporary folder; on a cluster the setting
    is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="framewise-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/framewise-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder, compressed by ``codec``, and read it back.

    Cuts the lineage with files that outlive a lost executor, and lets Spark split hot keys of a
    later join, which it cannot do right above an aggregation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """Like ``stored``, in ``parts`` buckets by ``key``: grouping by it then needs no shuffle.

    The table's name is dropped at once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    title = "spark_catalog.default." + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(title, format="parquet")
    out = spark.table(title)
    spark.sql(f"drop table {title}")
    return out


def release(*models) -> None:
    """Drop the models that earlier tasks cached in this reused worker and hand free memory back.

    ``models`` are cached functions.  Where the C library has no way to trim, it keeps what it has.
    """
    for model in models:
        model.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``, whatever their case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def wide_hash(c: Column) -> Column:
    """Two independent 64-bit hashes: equal values only by a chance of 2^-128 a pair."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; an id of NULL does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
