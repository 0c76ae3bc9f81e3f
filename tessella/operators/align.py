"""Events aligned with dense series: sliding gathers, window means, moving averages.

A series is sparse: (unit, t, n) rows for the bins that aren't 0.  Window means go over
running sums, looked up as of the window's edges, instead of a range join.  A unit's series
is dealt over tasks by blocks of time, so no task holds a whole unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Times of a block.
SPAN = 1 << 16


def _block(t: Column, span: int) -> Column:
    return F.floor(t / span).cast("long")


def _blocks(series: DataFrame, unit: str, t: str, span: int) -> DataFrame:
    """(unit, _b, _lo, _hi): a row for each block from a unit's first time to its last, with these two."""
    ends = series.groupBy(unit).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return ends.select(unit, F.explode(F.sequence(_block(F.col("_lo"), span), _block(F.col("_hi"), span))).alias("_b"), "_lo", "_hi")


def densify(series: DataFrame, unit: str = "unit", t: str = "t", value: str = "n", span: int = SPAN) -> DataFrame:
    """Every bin from a unit's first to its last, 0 where the series has none; a NULL stays."""
    dealt = _blocks(series, unit, t, span).repartition(unit, "_b")  # a long unit's bins are made by many tasks
    bins = F.sequence(F.greatest("_lo", F.col("_b") * span), F.least("_hi", (F.col("_b") + 1) * span - 1))
    every = dealt.select(unit, F.explode(bins.cast(T.ArrayType(series.schema[t].dataType))).alias(t))
    return every.join(series.withColumn("_there", F.lit(True)), [unit, t], "left").select(unit, t, F.when(F.col("_there"), F.col(value)).otherwise(F.lit(0)).alias(value))


def moving_average(dense: DataFrame, width: int, unit: str = "unit", t: str = "t", value: str = "n", scale: float = 1.0, span: int = SPAN) -> DataFrame:
    """``rate``: the mean of ``width`` bins from width // 2 before on, edges mirrored (d c b a | a b c d | d c b a).

    Width 1 is the series itself.  Each block of a unit gets the bins that its own windows
    reach into; units mustn't be NULL.
    """
    if width == 1:
        return dense.withColumn("rate", F.col(value) * scale)
    span, before, after = max(span, width), width // 2, width - width // 2 - 1
    marked = dense.withColumn("_b", _block(F.col(t), span)).join(_blocks(dense, unit, t, span), [unit, "_b"])
    left = marked.where(F.col(t) < F.col("_lo") + before).withColumn(t, 2 * F.col("_lo") - F.col(t) - 1)
    right = marked.where(F.col(t) > F.col("_hi") - after).withColumn(t, 2 * F.col("_hi") - F.col(t) + 1)
    reach = F.sequence(_block(F.col(t) - after, span), _block(F.col(t) + before, span))
    padded = marked.unionByName(left).unionByName(right).withColumn("_b", F.explode(reach))
    mean = F.avg(value).over(Window.partitionBy(unit, "_b").orderBy(t).rangeBetween(-before, after))
    own = F.col(t).between(F.col("_lo"), F.col("_hi")) & (_block(F.col(t), span) == F.col("_b"))
    return padded.withColumn("rate", mean * scale).where(own).select(*dense.columns, "rate")


def offsets(pre: int, post: int, step: int, inclusive: bool = False) -> Column:
    """The offsets from -pre to post by step; post itself only if asked for."""
    last = post if inclusive else post - 1
    return F.sequence(F.lit(-pre), F.lit(last), F.lit(step))


def gather(events: DataFrame, series: DataFrame, steps: Column, at: Column, value: str = "n", unit: str = "unit") -> DataFrame:
    """(event, unit, off, resp): the series at the rounded anchor plus each offset, 0 where it has no bin, NULL where its bin is NULL."""
    wanted = events.select("event", unit, at.alias("_at"), F.explode(steps).alias("off")).withColumn("t", F.rint(F.col("_at") + F.col("off")).cast("long"))
    met = wanted.join(series.select(unit, "t", value, F.lit(True).alias("_there")), [unit, "t"], "left")
    return met.select("event", unit, "off", F.when(F.col("_there"), F.col(value)).otherwise(F.lit(0)).alias("resp"))


def sums_below(marks: DataFrame, series: DataFrame, value: str = "n", unit: str = "unit", span: int = SPAN) -> DataFrame:
    """``s`` for each mark (unit, t, ...): the sum of the unit's bins below t, 0 where there are none.

    Running sums are taken within blocks; what the blocks before add up to is carried in, for
    which one task sees a row for each of a unit's blocks.  Marks whose unit is NULL meet the bins without unit.
    """
    names = [c for c in marks.columns if c not in (unit, "t")]
    t = F.col("t").cast("double")
    tagged = marks.select(unit, t.alias("t"), *names, F.col("t").alias("_t"), F.lit(0.0).alias("_v"), F.lit(0).alias("_kind"))
    bins = series.select(unit, t.alias("t"), *[F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in names], F.lit(None).cast(marks.schema["t"].dataType).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    both = tagged.unionByName(bins).withColumn("_b", _block(F.col("t"), span))
    # a mark comes before the bin at its own time, so it sees those below it
    within = Window.partitionBy(unit, "_b").orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.coalesce(F.sum("_v").over(within), F.lit(0.0))).where("_kind = 0")
    earlier = Window.partitionBy(unit).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(unit, "_b").agg(F.sum("_v").alias("_s")).select(F.col(unit).alias("_u"), F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_carry"))
    met = found.join(carried, F.col(unit).eqNullSafe(F.col("_u")) & F.col("_b").eqNullSafe(F.col("_c")))
    return met.select(unit, F.col("_t").alias("t"), *names, (F.col("_own") + F.col("_carry")).alias("s"))


def window_means(events: DataFrame, series: DataFrame, start: Column, width: int, value: str = "n", unit: str = "unit", span: int = SPAN) -> DataFrame:
    """(event, unit, resp): the mean over [start, start + width) of a sparse series."""
    edges = events.select("event", unit, F.explode(F.array(F.struct(start.alias("t"), F.lit(-1).alias("sign")), F.struct((start + width).alias("t"), F.lit(1).alias("sign")))).alias("e"))
    found = sums_below(edges.select(unit, F.col("e.t").alias("t"), "event", F.col("e.sign").alias("sign")), series, value, unit, span)
    return found.groupBy("event", unit).agg((F.sum(F.col("s") * F.col("sign")) / width).alias("resp"))


def latency_window_means(events: DataFrame, series: DataFrame, latencies: DataFrame, width: int, least: int = 40, value: str = "n", unit: str = "unit") -> DataFrame:
    """As ``window_means``, from t + the unit's latency on, which is ``least`` at least."""
    shifted = events.join(latencies.select(unit, "latency"), unit)
    return window_means(shifted, series, F.col("t") + F.greatest("latency", F.lit(least)), width, value, unit)


def binned_response(events: DataFrame, series: DataFrame, centres: list[int], width: int, value: str = "n", unit: str = "unit") -> DataFrame:
    """(event, unit, off, resp): means over ``width`` bins centred on the onset plus each offset."""
    each = events.withColumn("off", F.explode(F.array(*[F.lit(c) for c in centres])))
    each = each.withColumn("event", F.struct("event", "off"))
    out = window_means(each, series, F.col("t") + F.col("off") - width // 2, width, value, unit)
    return out.select(F.col("event.event").alias("event"), unit, F.col("event.off").alias("off"), "resp")


def anchors(moves: DataFrame, to: str = "fixation") -> Column:
    """When a move is aligned: at its own onset (the end of the event before) or that of the event it leads to."""
    return F.col("to_start") if to == "fixation" else F.col("from_end")


def peri_event_histogram(events: DataFrame, series: DataFrame, pre: int, post: int, value: str = "n", unit: str = "unit") -> DataFrame:
    """(unit, off, total): counts at each offset of [-pre, post) summed over the unit's events."""
    return gather(events, series, offsets(pre, post, 1), F.col("t"), value, unit).groupBy(unit, "off").agg(F.sum("resp").alias("total"))


def nearest_to(rows: DataFrame, by: list[str], t: str = "t", centre: float = 0.0) -> DataFrame:
    """Each group's row time nearest to a centre, the earlier of two as near."""
    return rows.groupBy(*by).agg(F.min_by(t, F.struct(F.abs(F.col(t) - centre), F.col(t))).alias(t))
