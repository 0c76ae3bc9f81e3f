"""Cleaning, ranking and selecting interval events (fixations within presentations)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import border_distance, distance


def shift_by_latency(events: DataFrame, rigs: DataFrame, latencies: DataFrame, times: tuple[str, ...] = ("t0", "t1")) -> DataFrame:
    """Times moved back by the latency (ms) of the tracker of the session's rig; times are in seconds.

    ``rigs`` (session, rig, tracker) and ``latencies`` (rig, tracker, latency) are catalogues;
    events of a session in neither are left out.
    """
    found = rigs.join(latencies, ["rig", "tracker"]).select("session", "latency")
    met = events.join(found, "session")
    return met.withColumns({t: F.col(t) - F.col("latency") / 1000 for t in times}).drop("latency")


def overlapping(events: DataFrame, shown: DataFrame, key: str = "trial") -> DataFrame:
    """Events that overlap their presentation: end > onset and start <= offset (half strict)."""
    met = events.join(shown, key)
    return met.where((F.col("t1") > F.col("onset")) & (F.col("t0") <= F.col("offset")))


def clip_to_onset(events: DataFrame) -> DataFrame:
    """Starts at or before the onset moved to it, and flagged as the zeroth event."""
    return events.withColumn("zeroth", F.col("t0") <= F.col("onset")).withColumn("t0", F.greatest("t0", "onset"))


def relative_position(events: DataFrame) -> DataFrame:
    return events.withColumn("rx", F.col("x") - F.col("px")).withColumn("ry", F.col("y") - F.col("py"))


def durations(events: DataFrame, scale: float = 1.0) -> DataFrame:
    """``duration`` and ``trial_time`` (not below 0), in units of 1/scale."""
    scaled = lambda c: c if scale == 1.0 else c * scale
    return events.withColumn("duration", scaled(F.col("t1") - F.col("t0"))).withColumn("trial_time", scaled(F.greatest(F.col("t0") - F.col("onset"), F.lit(0))))


def ordinals(events: DataFrame, key: str = "trial", order: tuple[str, ...] = ("t0", "fix_id")) -> DataFrame:
    """``ord``: the rank in the trial from 1, from 0 in trials with a zeroth event."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    zeroth = F.max(F.col("zeroth").cast("int")).over(Window.partitionBy(key))
    return events.withColumn("ord", rank - zeroth)


def neighbour(events: DataFrame, step: int, column: str = "fix_id", key: str = "trial") -> Column:
    """``column`` of the event ``step`` ordinals on in the trial (negative: before), NULL if that ordinal is missing."""
    w = Window.partitionBy(key).orderBy("ord", "fix_id")
    beside = F.lag if step < 0 else F.lead
    return F.when(beside("ord", abs(step)).over(w) == F.col("ord") + step, beside(column, abs(step)).over(w))


def with_neighbours(events: DataFrame, key: str = "trial") -> DataFrame:
    return events.withColumns({"prev_id": neighbour(events, -1, key=key), "next_id": neighbour(events, 1, key=key)})


def select_events(events: DataFrame, length: int, least_duration: float, margin: float, width: float, height: float) -> DataFrame:
    """Long enough, away from the ends of the presentation and strictly inside the image."""
    inside = border_distance(F.col("rx"), F.col("ry"), F.lit(float(width)), F.lit(float(height))) < 0
    return events.where((F.col("duration") >= least_duration) & (F.col("trial_time") >= margin) & (F.col("trial_time") + F.col("duration") <= length - margin) & inside)


def by_ordinal(events: DataFrame, which: str) -> DataFrame:
    """``which`` is "zeroth", "nonzeroth" or "both"."""
    return events if which == "both" else events.where(F.col("ord") == 0 if which == "zeroth" else F.col("ord") != 0)


def transitions(events: DataFrame, key: str = "trial") -> DataFrame:
    """A selected event and its selected predecessor: (trial, from_id, to_id, to_ord, dx, dy, size)."""
    w = Window.partitionBy(key).orderBy("ord", "fix_id")
    before = lambda c: F.lag(c).over(w)
    met = events.select(
        key, F.col("fix_id").alias("to_id"), F.col("ord").alias("to_ord"), F.col("t0").alias("to_start"), before("fix_id").alias("from_id"), before("ord").alias("from_ord"),
        before("t1").alias("from_end"), (F.col("x") - before("x")).alias("dx"), (F.col("y") - before("y")).alias("dy"), distance(before("x"), before("y"), F.col("x"), F.col("y")).alias("size"),
    )
    return met.where(F.col("from_ord") == F.col("to_ord") - 1)


def large(moves: DataFrame, least: float = 4.0) -> DataFrame:
    return moves.where(F.col("size") >= least)


def separations(moves: DataFrame, events: DataFrame, window: float, key: str = "trial") -> DataFrame:
    """``separation`` of each move: the least distance between what ended shortly before and what started shortly after.

    Before are events of an ordinal below the from-event that end within ``window`` before it
    ends; after are those above the to-event that start within ``window`` after it starts.
    With either side empty it is the move's own size.
    """
    e = events.select(key, F.col("ord").alias("e_ord"), F.col("t0").alias("e_t0"), F.col("t1").alias("e_t1"), F.col("x").alias("e_x"), F.col("y").alias("e_y"))
    keys = [key, "to_id"]
    before = moves.join(e, key).where((F.col("e_ord") < F.col("to_ord") - 1) & (F.col("e_t1") > F.col("from_end") - window)).select(*keys, F.col("e_x").alias("bx"), F.col("e_y").alias("by"))
    after = moves.join(e, key).where((F.col("e_ord") > F.col("to_ord")) & (F.col("e_t0") <= F.col("to_start") + window)).select(*keys, F.col("e_x").alias("ax"), F.col("e_y").alias("ay"))
    least = before.join(after, keys).groupBy(*keys).agg(F.min(distance(F.col("bx"), F.col("by"), F.col("ax"), F.col("ay"))).alias("least"))
    return moves.join(least, keys, "left").withColumn("separation", F.coalesce("least", "size")).drop("least")


def modal_value(rows: DataFrame, column: Column, step: float, over: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``modal``: the most frequent value rounded to ``step`` (of those above ``over``); tied modes are averaged and rounded again."""
    binned = rows.select(*by, (F.rint(column / step) * step).alias("bin")).where(F.col("bin").isNotNull())
    counts = (binned if over is None else binned.where(F.col("bin") > over)).groupBy(*by, "bin").count()
    top = counts.groupBy(*by).agg(F.max("count").alias("top"))
    ties = counts.join(top, list(by)) if by else counts.crossJoin(F.broadcast(top))  # one row
    return ties.where("count = top").groupBy(*by).agg((F.rint(F.avg("bin") / step) * step).alias("modal"))


def at_modal_value(rows: DataFrame, column: Column, step: float, over: float | None = None) -> DataFrame:
    """Rows whose rounded value is the modal one."""
    modal = modal_value(rows, column, step, over)
    return rows.crossJoin(F.broadcast(modal)).where(F.rint(column / step) * step == F.col("modal"))


def evenly_spaced(rows: DataFrame, k: int, key: str, order: tuple[str, ...]) -> DataFrame:
    """At most k rows of each group at even steps through its order, first and last among them."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    ranked = rows.withColumn("_n", n).withColumn("_at", at)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i.cast("double") / F.lit(float(max(1, k - 1))) * (F.col("_n") - 1)).cast("long"))
    return ranked.where(F.array_contains(wanted, F.col("_at").cast("long"))).drop("_n", "_at")


#: Rows of a quantile's neighbourhood are at most about this share of all, ties apart.
QUANTILE_SHARE = 10_000


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The quantiles of a column, linearly interpolated, as ``percentile`` gives them; NULLs are left out.

    Approximate quantiles bracket each one; ranks are counted over all rows, and only distinct values within the
    bracket are ever in one task.  A bracket that misses its rank is widened to the end of the column.
    """
    v = F.col(column).cast("double")
    given = rows.where(v.isNotNull()).select(v.alias("v"))
    around = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-2 / QUANTILE_SHARE, 2 / QUANTILE_SHARE)]
    n, least, most, ends = given.agg(F.count("*"), F.min("v"), F.max("v"), F.percentile_approx("v", around, QUANTILE_SHARE)).first()
    out: list[float | None] = []
    for k, share in enumerate(shares):
        if not n:
            out.append(None)
            continue
        at = (n - 1) * share
        low, high = math.floor(at), math.ceil(at)
        lo, hi = F.lit(ends[2 * k]), F.lit(ends[2 * k + 1])
        below, up_to = given.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
        if below > low:
            lo, below = F.lit(least), 0
        if up_to <= high:
            hi = F.lit(most)
        counts = given.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v")) + below)
        one, two = upto.agg(F.min(F.when(F.col("upto") > low, F.col("v"))), F.min(F.when(F.col("upto") > high, F.col("v")))).first()
        out.append(one if low == high else (high - at) * one + (at - low) * two)
    return out


def outlier_bounds(rows: DataFrame, column: str, low: float = 0.025, high: float = 0.975, widen: float = 0.1) -> DataFrame:
    """One row (lo, hi): the percentiles widened by a share of their span, lo not below 0."""
    q = [F.lit(x).cast("double") for x in exact_quantiles(rows, column, [low, high])]
    span = (q[1] - q[0]) * widen
    return rows.sparkSession.range(1).select(F.greatest(q[0] - span, F.lit(0.0)).alias("lo"), (q[1] + span).alias("hi"))


def sequence_starts(words: DataFrame, pattern: list[str], column: str, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows at which a run of given codes begins, in the order of time within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    hit = F.lit(True)
    for i, code in enumerate(pattern):
        hit = hit & ((F.lead(column, i).over(w) if i else F.col(column)) == code)
    return words.withColumn("_hit", hit).where("_hit").drop("_hit")


def trials_with_event(trials: DataFrame, words: DataFrame, code: str, margin: float, column: str = "event_type", key: str = "trial") -> DataFrame:
    """``n_found`` for each trial: events of a code within [start - margin, end + margin]."""
    w = words.where(F.col(column) == code).select(F.col(key).alias("_key"), F.col("t").alias("_t"))
    met = trials.join(w, (F.col(key) == F.col("_key")) & (F.col("_t") >= F.col("start") - margin) & (F.col("_t") <= F.col("end") + margin), "left")
    return met.groupBy(*trials.columns).agg(F.count("_t").alias("n_found"))


def covered_bins(intervals: DataFrame, start: str = "t0", stop: str = "t1", keys: tuple[str, ...] = ("trial",)) -> DataFrame:
    """The unit bins [start, stop) that intervals cover, each once."""
    bins = F.explode(F.when(F.col(stop) > F.col(start), F.sequence(F.col(start), F.col(stop) - 1)))
    return intervals.select(*keys, bins.alias("bin")).distinct()
