"""Sinks: idempotent, committed and resumable writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import nan_to_null, quantize


class AlreadyDone(RuntimeError):
    """The result is there and was committed."""


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often; NULL equals NULL and NaN equals NaN."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def save(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> str:
    """Write once: "created", "equal" if the same rows are there, "overwritten" if allowed, else an error."""
    old = read_if_there(df.sparkSession, path)
    if old is not None and same_rows(df, old):
        return "equal"
    if old is not None and not overwrite:
        raise ValueError(f"{path} holds other rows")
    writer = df.write.option("compression", "zstd").mode("overwrite" if old is not None else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return "created" if old is None else "overwritten"


def save_quantized(df: DataFrame, path: str, digits: int, columns: list[str], **how) -> str:
    """As ``save``, with NaN made NULL and numbers rounded to few mantissa bits, which compress well."""
    return save(df.withColumns({c: quantize(nan_to_null(F.col(c)), digits) for c in columns}), path, **how)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table lacks; returns how many."""
    old = read_if_there(df.sparkSession, path)
    new = df if old is None else df.join(old.select(*keys).distinct(), keys, "left_anti")
    new.write.option("compression", "zstd").mode("append").parquet(path)
    return df.sparkSession.read.parquet(path).count() - (0 if old is None else old.count())


class Results:
    """Variables of one analysis under a folder, with a config table and a commit mark."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def config(self) -> DataFrame:
        old = read_if_there(self.spark, f"{self.root}/config")
        return old if old is not None else self.spark.createDataFrame([], "session string, analysis string, key string, value string")

    def set(self, session: str, analysis: str, **values: object) -> None:
        rows = [(session, analysis, k, str(v)) for k, v in values.items()]
        self.spark.createDataFrame(rows, "session string, analysis string, key string, value string").coalesce(1).write.mode("append").parquet(f"{self.root}/config")

    def is_done(self, session: str, analysis: str) -> bool:
        c = self.config()
        return not c.where((F.col("session") == session) & (F.col("analysis") == analysis) & (F.col("key") == "all_done") & (F.col("value") == "true")).isEmpty()

    def guard(self, session: str, analysis: str) -> None:
        if self.is_done(session, analysis):
            raise AlreadyDone(f"{analysis} of {session}")

    def write(self, variable: str, df: DataFrame, **how) -> str:
        return save(df, f"{self.root}/{variable}", **how)

    def read(self, variable: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{variable}")

    def link(self, variable: str, view: str) -> None:
        """A name for a variable's table in this session."""
        self.read(variable).createOrReplaceTempView(view)

    def copy(self, variable: str, other: Results, **how) -> str:
        return other.write(variable, self.read(variable), **how)

    def commit(self, session: str, analysis: str) -> None:
        self.set(session, analysis, all_done="true")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
