"""Tables in the shared folder, for steps that are read more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import new_path, remove, ship

#: With it, the shuffle files of a finished write do not wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and written where every executor can read it; lost executors take nothing with them."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, tag)
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def spread(df: DataFrame) -> DataFrame:
    """df in so many parts that all cores work: small rows of a small file whose work comes after, which the file's few parts would leave to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


#: A task of a step over all rows gets about so many.
ROWS = 1_000_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df by keys, in parts of about so many rows and no fewer than shuffles have: what a task holds does not grow with the data."""
    return df.repartition(part_count(df, rows), *keys)


def part_count(df: DataFrame, rows: int = ROWS) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has made, once all that reads them has been written itself."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


def in_order(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with each row's place, from 1, in an order of all rows; ties are put in any order.

    Rows are dealt into ranges of the order, which are written once, so that places within a range and
    the sizes of the ranges before it agree; no task orders all rows. ranges says how many, else as many as
    shuffles have.
    """
    dealt = stored((df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__row", within).join(sizes, "__range").withColumn(name, F.col("__row") + F.col("__before")).drop("__range", "__row", "__before")
