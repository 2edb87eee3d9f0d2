"""Ranking without sorting everything in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALT = 256


def top_k(df: DataFrame, keys: list[str], order: list, k: int, spread: str, name: str) -> DataFrame:
    """The first ``k`` rows of each key with their place: first of each slice of ``spread``, then of those."""
    slice_ = F.pmod(F.xxhash64(spread), F.lit(SALT))
    first = F.row_number().over(Window.partitionBy(*keys, slice_).orderBy(*order))
    df = df.withColumn(name, first).filter(F.col(name) <= k)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def with_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """Add the place (from 1) of every row in the order of an integer column.

    Rows are numbered within spans of 65,536 values, and each span starts where
    the spans before it end.
    """
    df = df.withColumn("__span", F.shiftright(F.col(by).cast("long"), 16))
    before = df.groupBy("__span").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("__span", F.coalesce(F.sum("__n").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__span").orderBy(by))
    return df.withColumn("__at", at).join(before, "__span").withColumn(name, F.col("__before") + F.col("__at")).drop("__span", "__at", "__before")


def first_per(df: DataFrame, keys: list, order: list, limit: int = 1, name: str = "__rn") -> DataFrame:
    """The first ``limit`` rows of each key; Spark cuts each map task's rows before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= limit)
    return out.drop(name) if name == "__rn" else out


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine alone a temporary one stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loom-shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder."""
    return f"{_folder(spark).rstrip('/')}/{name}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, for plans that read it many times."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def settled(top: DataFrame) -> DataFrame:
    """The rows of a top-k result as a table of their own: what reads it several times doesn't search again.

    Only for results that a limit bounds, and for the terms of stated queries.
    """
    return top.sparkSession.createDataFrame(top.collect(), top.schema)
