"""Factor levels taken from the data: the distinct values in order, numbered 1, 2, 3, …

The distinct values are dealt out by range, so a partition's values lie between its neighbours'.  Each value's place in
its partition plus the values of the partitions before it (``sources.rows``: one row for each partition) is its level, so no
task sorts all values.  The dealt values are written once, since levels need the same partitions twice, also after
a task was run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plotstats.plans.session import scratch_path
from plotstats.sources.rows import FILE, PLACE, START, number_rows


def factor_levels(df: DataFrame, column: str) -> DataFrame:
    """value, level (1-based) of the distinct values of ``column`` in its type's order (text by its bytes); NULL is no
    level.  The result reads a table below the checkpoint folder, which stays as long as the caller needs it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "levels")
    values = df.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
    values.repartitionByRange("value").select("value", F.spark_partition_id().cast("long").alias(START)).write.parquet(path)
    schema = StructType([StructField("value", values.schema["value"].dataType), StructField(START, LongType())])
    place = F.row_number().over(Window.partitionBy(START).orderBy("value")).cast("long")
    placed = spark.read.schema(schema).parquet(path).select("value", F.lit("").alias(FILE), START, place.alias(PLACE))
    return number_rows(placed, "level").select("value", "level")


def with_levels(df: DataFrame, column: str, name: str, levels: DataFrame | None = None) -> DataFrame:
    """``df`` with the level of ``column`` as ``name``; NULL where ``column`` is NULL or not among ``levels``."""
    levels = factor_levels(df, column) if levels is None else levels
    levels = levels.select(F.col("value").alias("__level_value"), F.col("level").alias(name))
    return df.join(levels, F.col(f"`{column}`") == F.col("__level_value"), "left").drop("__level_value")
