"""The given tables in the shape of fields and observations, so that results can be checked in SQL.

FIELD: model_name, is_base, variable, units, forecast_reference_time, forecast_period
(hours), time, realization, level_type, level, iy, ix, y, x, value. Grid indices iy and
ix are the join keys; coordinates y and x are only for places. OBS: station, time,
variable, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("realization", "time", "iy", "ix")
#: Vectors of one field of ``slabs``.
ROWS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model_name"),
        (F.col("l_returnflag") == "A").alias("is_base"),
        (F.col("l_linenumber") - 1).alias("realization"),
        (F.col("l_suppkey") % 5).cast("int").alias("iy"),
        (F.col("l_partkey") % 8).cast("int").alias("ix"),
        month.alias("time"),
        month.alias("forecast_reference_time"),
        (24.0 * (F.dayofmonth("l_shipdate") - 1)).alias("forecast_period"),
        F.col("l_quantity").alias("value"),
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


def member_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly fields of each model and member: value is the mean quantity of a cell."""
    return lines(spark, sf_dir).groupBy("model_name", "is_base", *CELL).agg(F.avg("value").alias("value")).withColumn("variable", F.lit("quantity")).withColumn("units", F.lit("1"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``member_field``, without members."""
    cells = lines(spark, sf_dir).groupBy("model_name", "is_base", "time", "iy", "ix").agg(F.avg("value").alias("value"))
    return cells.withColumn("variable", F.lit("quantity")).withColumn("units", F.lit("1"))


def case_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast cases: a reference time a month, a lead time a day."""
    return lines(spark, sf_dir).groupBy("model_name", "is_base", "forecast_reference_time", "forecast_period", "iy", "ix").agg(F.avg("value").alias("value"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line item with temperature (K), pressure (hPa), relative humidity and two wind components."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (250 + F.col("l_quantity")).alias("t"),
        (500 + 5000 * F.col("l_discount")).alias("p"),
        (0.05 + 10 * F.col("l_tax")).alias("rh"),
        (F.col("l_quantity") - 25).alias("u"),
        (F.col("l_linenumber") - 3.5).alias("v"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("variable"), "value", "event_id"
    )


def slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 64 columns, ROWS vectors each: part numbers a label's fields, iy the vectors of one, ix is the place in the vector.

    A label's row number comes from an ordered window over ids alone, so no task sorts vectors.
    The last field of a label has the vectors that are left.
    """
    from pyspark.sql import Window

    vectors = table(spark, sf_dir, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = vectors.select("vec_id", n.alias("n")).select("vec_id", F.floor(F.col("n") / ROWS).cast("int").alias("part"), (F.col("n") % ROWS).cast("int").alias("iy"))
    return vectors.join(rows, "vec_id").select(F.col("label").alias("time"), "part", "iy", F.posexplode("embedding").alias("ix", "value")).withColumn("value", F.col("value").cast("double"))
