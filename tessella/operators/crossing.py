"""Crossing points of two series, peaks and half-height times, singly and down a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def crossings(series: DataFrame, by: list[str], direction: str = "up", x: str = "t", y0: str = "y0", y1: str = "y1") -> DataFrame:
    """(by, t): where y1 > y0 becomes true ("up"), false ("down") or either ("both"), linearly interpolated.

    Samples where either series is missing are taken out first, so a crossing may bridge
    them; parallel pieces give no point.
    """
    w = Window.partitionBy(*by).orderBy(x)
    above = F.col(y1) > F.col(y0)
    s = series.where(_finite(y0) & _finite(y1)).withColumn("_d", (F.col(y1) - F.col(y0)).cast("double"))
    s = s.withColumns({"_up": above, "_was": F.lag(above).over(w), "_d0": F.lag("_d").over(w), "_x0": F.lag(x).over(w)})
    turned = {"up": ~F.col("_was") & F.col("_up"), "down": F.col("_was") & ~F.col("_up"), "both": F.col("_was") != F.col("_up")}[direction]
    t = F.col("_x0") + F.try_divide(-F.col("_d0") * (F.col(x) - F.col("_x0")), F.col("_d") - F.col("_d0"))
    return s.where(turned).select(*by, t.alias("t")).where(F.col("t").isNotNull())


def central_crossing(series: DataFrame, by: list[str], direction: str = "up", centre: Column | float = 0.0, x: str = "t", y0: str = "y0", y1: str = "y1") -> DataFrame:
    """(by, t, clearance): the distinct crossing nearest to the centre, the earlier of two as near.

    Clearance is the distance to the nearest other crossing, or with only one to the nearer
    edge of the series.  ``centre`` may be a column that is constant in a group.
    """
    good = series.where(_finite(y0) & _finite(y1))
    centre = centre if isinstance(centre, Column) else F.lit(float(centre))
    edges = good.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.first(centre).alias("c"), F.count("*").alias("n"))
    found = crossings(series, by, direction, x, y0, y1).distinct().join(edges.where("n >= 2"), by)
    w = Window.partitionBy(*by).orderBy("t")
    beside = F.least(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"))
    found = found.withColumn("clearance", F.coalesce(beside, F.least(F.col("t") - F.col("lo"), F.col("hi") - F.col("t"))))
    best = F.min_by(F.struct("t", "clearance"), F.struct(F.abs(F.col("t") - F.col("c")), F.col("t")))
    return found.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.t").alias("t"), F.col("b.clearance").alias("clearance"))


def peaks(series: DataFrame, by: list[str], x: str = "t", y: str = "y") -> DataFrame:
    """(by, peak_t, peak): the first of the largest values, missing ones left out."""
    return series.where(_finite(y)).groupBy(*by).agg(F.max_by(x, F.struct(F.col(y), -F.col(x))).alias("peak_t"), F.max(y).alias("peak"))


def half_height(series: DataFrame, by: list[str], x: str = "t", y: str = "y") -> DataFrame:
    """(by, t, clearance): the upward crossing of half the peak nearest to 0."""
    half = peaks(series, by, x, y).select(*by, (F.col("peak") / 2).alias("_half"))
    return central_crossing(series.join(half, by), by, "up", 0.0, x, "_half", y)


def hier_central_crossing(series: DataFrame, hierarchy: DataFrame, levels: list[str], by: list[str], direction: str = "up", least_clearance: float = 100.0, y0: str = "y0", y1: str = "y1") -> DataFrame:
    """Central crossings from the top level down.

    ``series`` has (level, name, *by, t, y0, y1); ``hierarchy`` (name, ancestor_level, ancestor) lists the
    ancestors of a name.  A child's search is centred on its nearest ancestor that has an
    estimate for the same ``by`` (say, a replicate) if that one's clearance is large enough, else on 0.
    """
    done = None
    for i, level in enumerate(levels):
        own = series.where(F.col("level") == level)
        keys = ["name", *by]
        if done is not None:
            rank = F.array_position(F.array(*[F.lit(x) for x in levels[:i]]), F.col("ancestor_level"))
            prior = hierarchy.join(done.select(F.col("level").alias("ancestor_level"), F.col("name").alias("ancestor"), *by, "t", "clearance"), ["ancestor_level", "ancestor"])
            prior = prior.groupBy(*keys).agg(F.max_by(F.struct("t", "clearance"), rank).alias("p"))
            centre = prior.select(*keys, F.when(F.col("p.clearance") >= least_clearance, F.col("p.t")).alias("_centre"))
            own = own.join(centre, keys, "left")
        else:
            own = own.withColumn("_centre", F.lit(None).cast("double"))
        found = central_crossing(own, keys, direction, F.coalesce("_centre", F.lit(0.0)), "t", y0, y1).withColumn("level", F.lit(level))
        done = found if done is None else done.unionByName(found)
    return done


def hier_peaks(series: DataFrame, levels: list[str], by: list[str]) -> DataFrame:
    """Peak times of every name of the given levels."""
    return peaks(series.where(F.col("level").isin(levels)), ["level", "name", *by])


def boot_rollup(boots: DataFrame, by: list[str], estimate: DataFrame, x: str = "t", clearance: str = "clearance") -> DataFrame:
    """Per group, over odd ("train") and even ("test") replicates b: bias, sd, mean clearance, valid share."""
    part = F.when(F.col("b") % 2 == 1, "train").otherwise("test").alias("part")
    met = boots.select(*by, "b", part, F.col(x).alias("_x"), F.col(clearance).alias("_c")).join(estimate.select(*by, F.col(x).alias("_e")), by)
    return met.groupBy(*by, "part").agg(
        (F.avg("_x") - F.first("_e")).alias("bias"), F.stddev_pop("_x").alias("sd"), F.avg("_c").alias("mean_clearance"), F.try_divide(F.count("_x").cast("double"), F.count("*")).alias("valid")
    )


def acceptable_latency(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, report): units that pass every criterion, and how many pass each.

    Means and SDs of replicates are compared up to nine decimals, as their last bits depend on the order in which a shuffle brings the replicates.
    """
    bias, sd, mean_clearance = (F.round(c, 9) for c in ("bias", "sd", "mean_clearance"))
    criteria = {
        "finite": F.col("t").isNotNull() & ~F.isnan("t"), "clear": F.col("clearance") >= 100, "between_peaks": F.col("t").between(F.least("peak0", "peak1"), F.greatest("peak0", "peak1")),
        "valid": F.col("valid") >= 0.5, "unbiased": F.abs(bias) < 25, "precise": sd < 25, "clear_boots": mean_clearance >= 100,
    }
    every = F.lit(True)
    for c in criteria.values():
        every = every & F.coalesce(c, F.lit(False))
    return rows.where(every), rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in criteria.items()], F.count("*").alias("total"))


def runs(rows: DataFrame, by: list[str], flag: Column, x: str = "t") -> DataFrame:
    """(by, start, stop, n): runs of rows in order for which a flag holds."""
    w = Window.partitionBy(*by).orderBy(x)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    turn = (F.col("_f") != F.coalesce(F.lag("_f").over(w), ~F.col("_f"))).cast("int")
    island = marked.withColumn("_turn", turn).withColumn("_i", F.sum("_turn").over(w))
    return island.where("_f").groupBy(*by, "_i").agg(F.min(x).alias("start"), F.max(x).alias("stop"), F.count("*").alias("n")).drop("_i")
