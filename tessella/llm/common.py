"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.scratch import materialize, release, scratch_path

__all__ = ["LOWER", "SPACE", "UPPER", "WORD_PATTERN", "ascii_lower", "lookup_skewed", "materialize", "partitions", "release", "scratch_path", "shuffle_partitions"]

#: The separators of words: space and the controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession, rows: float, per_task: int) -> int:
    """So many partitions that a task gets about ``per_task`` rows at most, whatever the session's default is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // per_task) + 1)


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Within, joins and aggregations shuffle into ``n`` partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def lookup_skewed(left: DataFrame, right: DataFrame, keys: list[str], uses: str, share: int = 1000) -> DataFrame:
    """``left`` left-joined with ``right``, whose keys are unique; ``uses`` counts the left rows of a key.

    A key used by more than 1/``share`` of all uses is hot.  There can be no more than
    ``share`` of them, so they are broadcast; hot left rows are spread over salts and
    meet a copy of their right row at each, all others meet at salt 0.  Keys are
    compared null-safely.
    """
    spark = left.sparkSession
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = right.agg(F.sum(uses)).first()[0] or 0
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    hot = right.where(F.col(f"_r_{uses}") * share > F.lit(total)).select(*[F.col(f"_r_{k}").alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))

    def tagged(df: DataFrame, prefix: str) -> DataFrame:
        same = [F.col(f"{prefix}{k}").eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
        return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])

    salted = tagged(left, "").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.expr(f"sequence(0L, {salts - 1}L)")).otherwise(F.expr("array(0L)"))
    spread = tagged(right, "_r_").withColumn("_r_salt", F.explode(every)).drop("_hot")
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    met = salted.join(spread, [*same, F.col("_salt") == F.col("_r_salt")], "left")
    return met.select(*left.columns, *[F.col(c).alias(c[3:]) for c in right.columns if c[3:] not in keys])
