"""The domain's tables as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Lines of an order at most, so that fix_id is unique without a global sort; more fail the query.
ROWS_PER_TRIAL = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: F.Column) -> F.Column:
    return F.unix_date(ts.cast("date")).cast("long")


def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fixations: an order is a trial, a part an image, a day a unit of time."""
    line = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    seq = F.when(seq <= ROWS_PER_TRIAL, seq).otherwise(F.raise_error(F.lit(f"an order has more than {ROWS_PER_TRIAL} lines")))
    t0 = day(F.col("l_shipdate"))
    return line.select(
        F.col("l_orderkey").alias("trial"), (F.col("l_orderkey") * ROWS_PER_TRIAL + seq).alias("fix_id"), F.col("l_partkey").alias("image"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), t0.alias("t0"), (t0 + 1 + F.col("l_linenumber")).alias("t1"),
        F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


FIX = f"""fix AS (
  SELECT l_orderkey AS trial, l_orderkey * {ROWS_PER_TRIAL} + row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)}) AS fix_id, l_partkey AS image,
         l_quantity AS x, round(l_discount * 100) AS y, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS t0,
         date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 1 + l_linenumber AS t1, l_extendedprice AS price, l_tax AS tax, l_returnflag AS flag
  FROM lineitem)"""


def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as presentations: shown from the order date for 60 days."""
    orders = table(spark, sf_dir, "orders")
    t0 = day(F.col("o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("trial"), t0.alias("onset"), (t0 + 60).alias("offset"), F.col("o_custkey").alias("customer"), (F.col("o_custkey") % 20).cast("double").alias("px"), (F.col("o_custkey") % 7).cast("double").alias("py"))


PRES = """pres AS (
  SELECT o_orderkey AS trial, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS onset, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 60 AS "offset",
         o_custkey AS customer, CAST(o_custkey % 20 AS DOUBLE) AS px, CAST(o_custkey % 7 AS DOUBLE) AS py
  FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour as time."""
    ev = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return ev.select("event_id", F.col("user_id").alias("unit"), hour.alias("t"), "event_type", "value")


EV = """ev AS (
  SELECT event_id, user_id AS unit, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t, event_type, value FROM events)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units: a nation is a subject, a region a region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    met = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations and 5 regions at any scale
    return met.select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"), F.col("n_name").alias("subject"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment"))


CUST = """cust AS (
  SELECT c_custkey AS unit, c_name AS name, n_name AS subject, r_name AS region, c_acctbal AS value, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
