"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a run in one process (tests) gets a temporary folder; on a
    cluster that would be one machine's own disk, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` by way of a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def required(df: DataFrame, holds: DataFrame, message: str) -> DataFrame:
    """``df`` if the one value of ``holds`` is true, else an error when it runs; nothing runs before."""
    return df.where(F.when(holds.scalar(), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def found_in(df: DataFrame, points: DataFrame, keys: list[str], message: str) -> DataFrame:
    """``df`` at the distinct ``points`` of ``keys``; an error when it runs, if there are rows but no points."""
    any_points = points.agg(F.count("*")).scalar()
    met = df.join(points.select(*keys, F.lit(True).alias("__in")), keys, "left")
    # Not an inner join: that would pass over the rows, and the error with them, where there are no points.
    return met.where(F.when(any_points > 0, F.col("__in")).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).select(*df.columns)


def stored(df: DataFrame) -> DataFrame:
    """``df`` by way of a table in the shared folder, for loops of joins: unlike a checkpoint it has the size of its files, not an estimate that grows each time."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
