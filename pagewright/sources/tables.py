"""Reading tables with as many tasks as the work asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a split of an input file, as Spark has it by default.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores if it is too small to be cut into as many splits by its size.

    A small table is often a single split, and all that follows runs in one task. Larger inputs have splits
    enough and are left as they are, so nothing is shuffled at scale. Streams are left as they are too.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that is heavy by the row."""
    return spread(spark.read.parquet(path))
