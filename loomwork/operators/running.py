"""Ranks and running sums over groups of any size, without one task for a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import written


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys that stand before this row.

    Rows stand by block, then by order. Each (keys, block) is summed on its own; the blocks' totals, a small table, give
    what stands before each block. So a key with most of the rows is spread over its blocks. block must not fall as
    order rises. Keys compare null-safe; rows that tie on everything stand in any order.
    """
    rows = df.withColumns({"__block": block, "__value": value})
    within = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__within", F.sum("__value").over(within) - F.col("__value"))
    totals = df.select(*keys, block.alias("__block"), value.alias("__value")).groupBy(*keys, "__block").agg(F.sum("__value").alias("__total"))
    ahead = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("__ahead", F.sum("__total").over(ahead) - F.col("__total")).drop("__total")
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__ahead")
    on = F.col("__block").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(totals, on).withColumn(out, F.col("__within") + F.col("__ahead"))
    return joined.drop("__block", "__value", "__within", "__ahead", "__b", *[f"__k{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in one order over all rows, from 1. The order must be total for reruns to agree.

    Rows are range-sorted into partitions and written; a row's place is its place in its partition plus the counts of the
    partitions before, one number a partition, which the driver adds up. No task holds more than its range.
    """
    spark = df.sparkSession
    key = "__range"
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn(key, F.spark_partition_id())
    ranged = written(ranged, "ranged")
    before, sums = 0, []
    for row in ranged.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).collect():
        sums.append((row[key], before))
        before += row["n"]
    offsets = spark.createDataFrame(sums, f"{key} int, __before long")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) + F.col("__before")
    return ranged.join(F.broadcast(offsets), key).withColumn(name, place).drop(key, "__before")
