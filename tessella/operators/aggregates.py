"""Grouped statistics and normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.moments import statistic


def period_stats(series: DataFrame, periods: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Mean and population SD of a sparse series in each period (period, start, stop) of a unit; bins that are 0 count."""
    met = series.join(periods, by).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    sums = met.groupBy(*by, "period").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    bins = periods.groupBy(*by, "period").agg(F.sum(F.col("stop") - F.col("start")).alias("bins"))
    out = bins.join(sums, [*by, "period"], "left")
    mean = F.coalesce("s", F.lit(0)) / F.col("bins")
    return out.select(*by, "period", mean.alias("mean"), F.sqrt(F.greatest(F.coalesce("ss", F.lit(0)) / F.col("bins") - mean * mean, F.lit(0.0))).alias("sd"))


def stable_units(rows: DataFrame, unit: str, t: str, value: str, most_change: float = 0.5) -> DataFrame:
    """(unit, ratio): units whose mean in the second half of the time is neither 0 nor far from that of the whole.

    ``ratio`` is late over whole; units whose ratio differs from 1 by more than ``most_change`` are left out.
    """
    middle = rows.agg(((F.min(t) + F.max(t)) / 2).alias("_mid"))
    late = F.avg(F.when(F.col(t) >= F.col("_mid"), F.col(value)))
    halves = rows.crossJoin(F.broadcast(middle)).groupBy(unit).agg(late.alias("late"), F.avg(value).alias("whole"))  # one row
    return halves.withColumn("ratio", F.try_divide("late", "whole")).where((F.col("late") != 0) & (F.abs(F.col("ratio") - 1) <= most_change)).select(unit, "ratio")


def beyond_spread(rows: DataFrame, value: str, by: list[str], z: float = 1.65) -> DataFrame:
    """(by, earlier, later, n): how many values lie more than z population SDs of all below and above the mean of all."""
    spread = rows.agg(F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_m"))
    off = F.col(value) - F.col("_m")
    met = rows.crossJoin(F.broadcast(spread))  # one row
    return met.groupBy(*by).agg(F.count_if(off < -z * F.col("_sd")).alias("earlier"), F.count_if(off > z * F.col("_sd")).alias("later"), F.count("*").alias("n"))


def psth(rows: DataFrame, by: list[str], value: str = "resp") -> DataFrame:
    """Mean and population SD of each category, time and unit."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def standardize(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``z``: (x - mean) / population SD within a group, an SD of 0 taken as 1."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return rows.join(stats, by).withColumn("z", z).drop("_m", "_s")


def percentile_scaled(rows: DataFrame, value: str, by: list[str], q: float = 0.95) -> DataFrame:
    """``scaled``: divided by the group's percentile, 0 of which is taken as 1."""
    top = rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("_q"))
    return rows.join(top, by).withColumn("scaled", F.col(value) / F.when(F.col("_q") != 0, F.col("_q")).otherwise(1.0)).drop("_q")


def min_max_scaled(rows: DataFrame, value: str, by: list[str], reference: Column) -> DataFrame:
    """``scaled``: to 0..1 of what the reference rows of the group span; NULL where they span nothing."""
    span = rows.where(reference).groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return rows.join(span, by).withColumn("scaled", F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def mad(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The median, and the median absolute deviation from it."""
    centre = rows.groupBy(*by).agg(F.median(value).alias("median"))
    return rows.join(centre, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def robust_threshold(rows: DataFrame, value: str, by: list[str], z: float) -> DataFrame:
    """``kept``: positive values squared, others 0; then 0 below the group's median + z * MAD."""
    squared = rows.withColumn("kept", F.when(F.col(value) > 0, F.col(value) * F.col(value)).otherwise(0.0))
    stats = mad(squared, "kept", by)
    return squared.join(stats, by).withColumn("kept", F.when(F.col("kept") - F.col("median") < z * F.col("mad"), 0.0).otherwise(F.col("kept"))).drop("median", "mad")


def cdf(rows: DataFrame, value: str, by: list[str], lo: float, hi: float, step: float) -> DataFrame:
    """(by, bin, edge, share): the share of values up to each bin's upper edge; the last bin is closed on the right."""
    n_bins = round((hi - lo) / step)
    x = F.col(value)
    at = F.least(F.floor((x - lo) / step), F.lit(n_bins - 1)).cast("long")
    counts = rows.where((x >= lo) & (x <= hi)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    every = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    w = Window.partitionBy(*by)
    full = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    return full.select(*by, "bin", (lo + (F.col("bin") + 1) * step).alias("edge"), share.alias("share"))


def histogram(rows: DataFrame, value: str, by: list[str], lo: float, step: float) -> DataFrame:
    """(by, bin, n, density) on bins of one width; density integrates to 1 in a group."""
    counts = rows.groupBy(*by, F.floor((F.col(value) - lo) / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("density", F.col("n") / (total * step))


def shares(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by, column, n, share): how large a part each value has."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    met = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))  # one row
    return met.withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def describe_groups(rows: DataFrame, value: str, subject: str) -> DataFrame:
    """Mean, sample SD and median of the subjects' means."""
    means = rows.groupBy(subject).agg(F.avg(value).alias("m"))
    return means.agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.median("m").alias("median"))


def median_table(rows: DataFrame, by: list[str], values: list[str], first: dict[str, str]) -> DataFrame:
    """Medians, means and counts of each group, and of other columns the first in an order: {column: order}."""
    out = [F.median(v).alias(f"{v}_median") for v in values] + [F.avg(v).alias(f"{v}_mean") for v in values]
    return rows.groupBy(*by).agg(*out, *[F.min_by(c, o).alias(c) for c, o in first.items()], F.count("*").alias("n"))


def group_statistics(rows: DataFrame, levels: list[str], value: str, stat: str = "mean", by: tuple[str, ...] = (), unit: str = "unit") -> DataFrame:
    """(level, name, members, *by, value): a statistic of every group of two or more units at each level.

    Groups of different names that hold the same units are one group with all its names.
    """
    long = rows.select(unit, *by, value, F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in levels])).alias("g"))
    long = long.select(unit, *by, value, F.col("g.level").alias("level"), F.col("g.name").alias("name")).where("name is not null")
    members = long.select("level", "name", unit).distinct()
    # equal member sets by count and two sums of hashes: no list of a group's members is gathered
    sets = members.groupBy("level", "name").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64(unit).cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), unit).cast("decimal(20,0)")).alias("h2")
    )
    sets = sets.where("members >= 2")
    names = sets.groupBy("members", "h1", "h2").agg(F.min(F.struct("level", "name")).alias("one"), F.array_sort(F.collect_list(F.concat_ws("/", "level", "name"))).alias("names"))
    kept = names.select(F.col("one.level").alias("level"), F.col("one.name").alias("name"), "members", "names")
    return long.join(kept, ["level", "name"]).groupBy("names", "members", *by).agg(statistic(stat, F.col(value)).alias(value))


def selectivity_classes(rows: DataFrame, least_r: float = 0.1) -> DataFrame:
    """``visual`` and ``specific`` flags out of valid, reject, r and reject2."""
    visual = F.col("valid") & F.col("reject") & (F.col("r") >= least_r)
    return rows.withColumn("visual", F.coalesce(visual, F.lit(False))).withColumn("specific", F.coalesce(visual & F.col("reject2"), F.lit(False)))


def contingency(rows: DataFrame, significant: Column, direction: Column, kind: Column) -> DataFrame:
    """(kind, significant, direction, n) of every combination that occurs."""
    return rows.groupBy(kind.alias("kind"), significant.alias("significant"), direction.alias("direction")).agg(F.count("*").alias("n"))


def normalised_fit(r: Column, ceiling: Column) -> Column:
    """(clip(r / ceiling, 0, 1)) squared; undefined without a positive ceiling."""
    return F.when(ceiling > 0, F.pow(F.least(F.greatest(r / ceiling, F.lit(0.0)), F.lit(1.0)), 2))


def baseline_regression(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R squared of y on x; NULL where x doesn't vary."""
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return good.groupBy(*by).agg(*[F.when(F.var_pop(x) > 0, f(y, x)).alias(name) for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))])


def by_grid_length(rows: DataFrame, session: str, t: str, region: str, unit: str, least_units: int = 25) -> DataFrame:
    """(n_t, region, n_units): sessions parted by how long their time grid is; regions with enough units."""
    length = rows.groupBy(session).agg(F.count_distinct(t).alias("n_t"))
    units = rows.select(session, region, unit).distinct().join(length, session)
    return units.groupBy("n_t", region).agg(F.count_distinct(unit).alias("n_units")).where(F.col("n_units") >= least_units)
