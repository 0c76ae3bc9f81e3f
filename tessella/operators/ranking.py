"""Ranks and groups over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.scratch import materialize


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``name``: the row's place from 1 in a global order (a total order, if reruns have to agree).

    Rows are dealt by ranges of the order, numbered within each range, and shifted by the
    counts of the ranges before; only a row for each range is ever in one task.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def rank_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``name``: the row's place from 1 among the rows of its group, however large; keys mustn't be NULL."""
    ranked = global_rank(rows, [*by, *order], "_place")
    first = ranked.groupBy(*by).agg((F.min("_place") - 1).alias("_first"))
    return ranked.join(first, by).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def running_total(ranked: DataFrame, rank: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """``name``: the sum of ``value`` up to the row's rank, by blocks of ranks; ranks are distinct."""
    at = F.floor((F.col(rank) - 1) / block).cast("long")
    blocks = ranked.groupBy(at.alias("_b")).agg(F.sum(value).alias("_s"))
    before = blocks.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))  # a row for each block
    own = F.sum(value).over(Window.partitionBy("_b").orderBy(rank))
    return ranked.withColumn("_b", at).withColumn(name, own).join(before, "_b").withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_before")


def task_count(spark: SparkSession, least: int = 0) -> int:
    """Tasks for a shuffle whose number doesn't follow its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, least)


def spread_out(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` grouped by keys whose groups are little data but much work, over more tasks than their bytes would get."""
    return rows.repartition(task_count(rows.sparkSession), *keys).groupBy(*keys)
