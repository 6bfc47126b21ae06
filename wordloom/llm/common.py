"""Shared helpers: reading tables, writing intermediate tables to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one named in spark.checkpoint.dir, which all executors see.

    Where that is unset, a temporary folder serves a local master (tests); on a cluster it is an error.  The folder is
    deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="wordloom-shared-")
        _FOLDERS[app] = f"{base.rstrip('/')}/wordloom-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _FOLDERS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as it takes to be none of df's columns, in any case."""
    taken, front = {c.lower() for c in df.columns}, "__"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def smallest_hashes(df: DataFrame, keys: list[str], sample: int) -> DataFrame:
    """Rows that hold all of the ``sample`` keys of smallest hash, and few others: what is then ordered and cut is bounded at any size."""
    h = F.xxhash64(*keys).bitwiseAND(2**62 - 1)
    n = df.agg(F.approx_count_distinct(h)).first()[0]
    # the estimate is within a few hundredths; half as many again leaves room
    return df if n <= 2 * sample else df.where(h < int(1.5 * sample / n * 2**62))


def in_hash_order(keys: list[str]) -> list[Column]:
    return [F.xxhash64(*keys).bitwiseAND(2**62 - 1), *map(F.col, keys)]


def text_of(col: str | Column = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def content_key(text: Column) -> list[Column]:
    """96 bits that stand for a text: equal texts share them, different texts do not in practice."""
    return [F.xxhash64(text, F.lit(7)).alias("_k"), F.hash(text, F.lit(11)).alias("_k2")]


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
