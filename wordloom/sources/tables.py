"""Tables of a folder of Parquet files, with their rows dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt out where its files are fewer than the cores and small.

    A split begins at a row group, so that a few files of one row group each are read by as few tasks, and all that
    follows without an exchange runs in them too.  Only tables of up to one full split for each core are dealt out;
    larger ones have splits enough and are never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size <= cores * split else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
