"""Reading a table for work in Python tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_spread(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The columns of a Parquet table; dealt anew only where its files give fewer partitions than the cluster has cores.

    A small table often is one file of one row group, which would keep one core busy. Tables of as many
    partitions as cores, that is all large ones, stay as they are read.
    """
    df = spark.read.parquet(path).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
