"""Live event cleaning: overlap, clip and durations as events arrive, and windowed rates.

An addition to the batch operators: the same columns, over streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.events import clip_to_onset, durations, relative_position


def live_clean(events: DataFrame, shown: DataFrame, key: str = "trial", at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of events cleaned against a static table of presentations; repeats within the delay are dropped."""
    unique = events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, "fix_id"])
    met = unique.join(shown, key).where((F.col("t1") > F.col("onset")) & (F.col("t0") <= F.col("offset")))
    return durations(relative_position(clip_to_onset(met)))


def live_rates(events: DataFrame, unit: str = "unit", at: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "1 hour", value: Column | None = None) -> DataFrame:
    """(unit, start, n, mean): counts and means in tumbling or sliding windows, late events up to the delay."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, delay).groupBy(unit, window.alias("w")).agg(F.count("*").alias("n"), F.avg(value if value is not None else F.lit(1.0)).alias("mean"))
    return out.select(unit, F.col("w.start").alias("start"), "n", "mean")
