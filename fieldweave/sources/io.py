"""Reading and writing fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fields(spark: SparkSession, paths: list[str], model_names: list[str] | None = None, constraint: Column | None = None, subarea: Column | None = None, form: str = "parquet") -> DataFrame:
    """The sources at ``paths`` (files, globs or folders), each tagged with its model's name; the first is the base.

    Filters go to each source's scan. As many names as paths, or none (then "model 1" and so on).
    """
    if model_names is not None and len(model_names) != len(paths):
        raise ValueError(f"{len(model_names)} model names for {len(paths)} paths")
    if not paths:
        raise ValueError("no paths")
    names = model_names or [f"model {i + 1}" for i in range(len(paths))]
    sources = []
    for i, (path, name) in enumerate(zip(paths, names, strict=True)):
        source = spark.read.format(form).load(path)
        for condition in (constraint, subarea):
            source = source if condition is None else source.where(condition)
        sources.append(source.withColumn("model_name", F.lit(name)).withColumn("is_base", F.lit(i == 0)))
    return combine(*sources)


def one_field(fields: DataFrame) -> DataFrame:
    """``fields`` if they are one variable of one model; else an error. Looks at two distinct names at most."""
    found = fields.select("model_name", "variable").distinct().limit(2).count()
    if found != 1:
        raise ValueError("no field" if not found else "more than one field")
    return fields


def select_fields(fields: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet any of ``conditions``; an error without a condition, or if nothing is left."""
    if not conditions:
        raise ValueError("no condition")
    found = fields.where(reduce(lambda a, b: a | b, conditions))
    if found.isEmpty():
        raise ValueError("no field meets a condition")
    return found


def rename(fields: DataFrame, name: str) -> DataFrame:
    return fields.withColumn("variable", F.lit(name))


def remove_attributes(fields: DataFrame, names: list[str]) -> DataFrame:
    """Without the attributes ``names``, or those it has of them."""
    return fields.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~k.isin(*names)))


def remove_constant_columns(fields: DataFrame, names: list[str]) -> DataFrame:
    """Without those of the columns ``names`` that hold one value throughout: one aggregation finds them."""
    names = [n for n in names if n in fields.columns]
    if not names:
        return fields
    many = fields.agg(*((F.count_distinct(n) + F.max(F.col(n).isNull().cast("int"))).alias(n) for n in names)).first()
    return fields.drop(*(n for n in names if (many[n] or 0) <= 1))


def combine(*fields: DataFrame) -> DataFrame:
    """All rows of ``fields``; a column that one lacks is null there."""
    if not all(isinstance(f, DataFrame) for f in fields):
        raise TypeError("only DataFrames can be combined")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fields)


def write_field(field: DataFrame, path: str, overwrite: bool = False) -> None:
    field.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("model_name", "variable").parquet(path)


def read_surface_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports in columns parted by white space under a header, quoted by '; time from YR MN DY HR MI, TT from Celsius to K."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    header = raw.first()
    if header is None:
        raise ValueError(f"nothing in {path}")
    names = header["value"].split()
    # A quoted field keeps its blanks: they are not followed by an even number of quotes.
    parts = F.split(F.trim("value"), r"\s+(?=(?:[^']*'[^']*')*[^']*$)")
    rows = raw.where(F.col("value") != header["value"]).select(*(F.trim(F.get(parts, F.lit(i)), F.lit("'")).alias(n) for i, n in enumerate(names)))
    whole = [F.col(c).cast("int") for c in ("YR", "MN", "DY", "HR", "MI")]
    stamped = rows.withColumn("vld", F.make_timestamp(*whole, F.lit(0)))
    return stamped.withColumn("TT", F.col("TT").cast("double") + 273.15) if "TT" in names else stamped


def write_point_reports(reports: DataFrame, path: str) -> None:
    """Tab-separated point reports without a header: NA for null, times as yyyymmdd_HHMM."""
    shown = [F.date_format(c, "yyyyMMdd_HHmm").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in reports.dtypes]
    reports.select(*shown).write.csv(path, sep="\t", nullValue="NA", emptyValue="", header=False)
