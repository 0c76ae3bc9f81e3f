"""Nested means of regions: hierarchical bootstraps and sign-flip tests.

Values travel as arrays of a subject or of a bucket of units; the task that holds an array
makes its draws for a block of replicates and multiplies.  Only sums by replicate are
shuffled, never a row for each unit and replicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import draws
from tessella.operators.ranking import spread_out

#: Tasks over which the replicates of an array are dealt.
PARTS = 8
#: Units of a subject, or of a region's bucket, that one task holds.
CHUNK = 1 << 16
BUCKET = 1 << 14
#: Subjects of a region that a task holds together.
SUBJECTS = 64
#: Replicates nearer to the observed value than this share of the mean magnitude tie with it, so sums may round.
TIE = 1e-9


def two_level(rows: DataFrame, value: str = "value", level1: str = "region", level2: str = "subject", stat=F.avg) -> DataFrame:
    """The statistic of each subject, then of a region's subjects: (region, centre, n_units, n_subjects)."""
    inner = rows.groupBy(level1, level2).agg(stat(value).alias("s"), F.count(value).alias("n"))
    return inner.groupBy(level1).agg(stat("s").alias("centre"), F.sum("n").alias("n_units"), F.count("*").alias("n_subjects"))


def _indexed(units: DataFrame, level1: str, level2: str, unit: str) -> DataFrame:
    """Units with their place in the subject, the subject's place in the region, and both sizes."""
    sub = units.groupBy(level1, level2).agg(F.count("*").alias("n_u"))
    w = Window.partitionBy(level1)
    sub = sub.withColumn("s_at", F.row_number().over(w.orderBy(level2)) - 1).withColumn("n_s", F.count("*").over(w))
    return units.withColumn("u_at", F.row_number().over(Window.partitionBy(level1, level2).orderBy(unit)) - 1).join(sub, [level1, level2])


def _range(n: int, part: int) -> range:
    return range(n * part // PARTS, n * (part + 1) // PARTS)


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")


def _matrix(table: pa.Table, at: str, first: int, size: int) -> np.ndarray:
    """A column for each row of the table, with its values at their places; NaN elsewhere."""
    out = np.full((size, table.num_rows), np.nan)
    lists = table.column(at).combine_chunks()
    column = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    out[lists.flatten().to_numpy() - first, column] = table.column("_value").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def hier_boots(rows: DataFrame, n_boot: int, seed: str, value: str = "value", level1: str = "region", level2: str = "subject", unit: str = "unit", extra: tuple[str, ...] = (), stat: str = "mean") -> DataFrame:
    """(region, *extra, b, centre): subjects drawn with replacement, then units within each; nested mean or median.

    The draws depend on replicate, region and slots alone, so all conditions and times
    (``extra`` columns) of a unit share them.  NULL values are left out of a statistic; a
    subject without any is left out of its region's.  The draws of a slot are a random cubic's values, so any
    four of them are independent.  Subjects of more than ``CHUNK`` units are held in
    parts and their sums added up, which a median can't be: it fails for them.
    """
    units = _indexed(rows.select(level1, level2, unit).distinct(), level1, level2, unit)
    placed = rows.select(level1, level2, unit, *extra, F.col(value).cast("double").alias("_v")).join(units, [level1, level2, unit])
    chunk = F.expr(f"u_at div {CHUNK}").alias("_chunk")
    held = F.collect_list(F.struct("u_at", "_v"))
    arrays = placed.groupBy(level1, "s_at", "n_s", "n_u", chunk, *extra).agg(held.alias("_held"))
    keys = [level1, *extra]
    ready = arrays.select(*keys, F.col(level1).cast("string").alias("_name"), "s_at", "n_s", "n_u", "_chunk", F.col("_held.u_at").alias("_at"), F.col("_held._v").alias("_value"), F.expr(f"s_at div {SUBJECTS}").alias("_block"), _parts())

    def work(table: pa.Table) -> pa.Table:
        name, n_s, chunk, part = (table.column(c)[0].as_py() for c in ("_name", "n_s", "_chunk", "_part"))
        subject = table.column("s_at").to_numpy()
        found = []
        replicates = np.array(_range(n_boot, part))
        for lo in range(0, len(replicates), max(1, draws.AT_ONCE // n_s)):
            some = replicates[lo : lo + max(1, draws.AT_ONCE // n_s)]
            chosen = draws.cubic(np.array([draws.words(f"{seed}-subject", b, name) for b in some]), np.arange(n_s)) % n_s
            for s in np.unique(subject):
                own = np.flatnonzero(subject == s)
                n_u = table.column("n_u")[int(own[0])].as_py()
                if stat != "mean" and n_u > CHUNK:
                    raise ValueError(f"a subject has {n_u} units; a median is taken of {CHUNK} at most")
                first, size = chunk * CHUNK, min(CHUNK, n_u - chunk * CHUNK)
                values = _matrix(table.take(own), "_at", first, size)
                b, slot = np.nonzero(chosen == s)
                for at in range(0, len(b), max(1, draws.AT_ONCE // max(n_u, size))):
                    pick = slice(at, at + max(1, draws.AT_ONCE // max(n_u, size)))
                    words = np.array([draws.words(f"{seed}-unit", some[i], name, j) for i, j in zip(b[pick], slot[pick], strict=True)])
                    sums, counts = _drawn(words, n_u, first, values, stat)
                    found.append((np.tile(own, len(words)), np.repeat(some[b[pick]], len(own)), np.repeat(slot[pick], len(own)), sums.ravel(), counts.ravel()))
        row, b, slot, sums, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2
        out = table.select(keys).take(row)
        for c, x in (("b", b.astype(np.int32)), ("slot", slot.astype(np.int64)), ("s", sums), ("n", counts.astype(np.int64))):
            out = out.append_column(c, pa.array(x))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.select(*keys).schema)
    sums = spread_out(ready, level1, "_block", "_chunk", "_part").applyInArrow(work, f"{kinds}, b int, slot long, s double, n long")
    inner = sums.groupBy(*keys, "b", "slot").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("s"))
    return inner.groupBy(*keys, "b").agg((F.avg if stat == "mean" else F.median)("s").alias("centre"))


def _drawn(words: np.ndarray, n_u: int, first: int, values: np.ndarray, stat: str) -> tuple[np.ndarray, np.ndarray]:
    """For each slot (a row of words) sum and number of the drawn values that are held here; of a median itself and 1."""
    size, n = len(values), len(words)
    if stat == "median":
        with np.errstate(all="ignore"):
            x = values[draws.cubic(words, np.arange(n_u)) % n_u]
            counts = np.isfinite(x).any(1).astype(np.float64)
            return np.where(counts > 0, np.nanmedian(np.where(counts[:, None] > 0, x, 0.0), axis=1), 0.0), counts
    times = np.zeros((n, size))
    for lo in range(0, n_u, draws.AT_ONCE):  # more than one pass only for subjects of which a part is held
        u = draws.cubic(words, np.arange(lo, min(n_u, lo + draws.AT_ONCE))) % n_u - first
        at = u + np.arange(n)[:, None] * size
        times += np.bincount(at.ravel() if size == n_u else at[(u >= 0) & (u < size)], minlength=n * size).reshape(n, size)
    have = ~np.isnan(values)
    return times @ np.where(have, values, 0.0), times @ have.astype(np.float64)


def spread(boots: DataFrame, by: list[str], kind: str = "ci", centre: Column | None = None, low: float = 0.025, high: float = 0.975, x: str = "centre") -> DataFrame:
    """Of bootstrap replicates: "ci" percentiles (lo, hi), "sem" about the centre, or "mad" about it."""
    if kind == "ci":
        return boots.groupBy(*by).agg(F.percentile(x, F.lit(low)).alias("lo"), F.percentile(x, F.lit(high)).alias("hi"))
    if kind == "sem":
        return boots.groupBy(*by).agg(F.sqrt(F.avg((F.col(x) - centre) * (F.col(x) - centre))).alias("sem"))
    return boots.groupBy(*by).agg(F.median(F.abs(F.col(x) - centre)).alias("mad"))


def sign_flip_test(rows: DataFrame, n_perm: int, seed: str, alternative: str = "greater", value: str = "value", level1: str = "region", level2: str = "subject", unit: str = "unit", extra: tuple[str, ...] = ()) -> DataFrame:
    """(region, *extra, observed, p, floor): the nested mean against random signs of the units.

    A unit has one sign in a replicate for all times: a bit of the MD5 of its name and the
    replicate's block of 128.  p is the share of replicates that reach the observed value
    (ties count, see ``TIE``), not clipped to its floor.  A nested mean is a weighted sum of its units, so a
    bucket of units adds signs times weights as one matrix product.
    """
    keys = [level1, *extra]
    valued = rows.where(F.col(value).isNotNull()).select(*keys, level2, unit, F.col(value).cast("double").alias("_v"))
    inner = valued.groupBy(*keys, level2).agg(F.avg("_v").alias("_s"), F.avg(F.abs("_v")).alias("_a"), F.count("*").alias("_n"))
    outer = inner.groupBy(*keys).agg(F.avg("_s").alias("observed"), F.avg("_a").alias("_scale"), F.count("*").alias("_subjects"), F.sum("_n").alias("_units"))
    sizes = outer.groupBy(level1).agg(F.expr(f"max(_units) div {BUCKET} + 1").alias("_buckets"))
    weighed = valued.join(inner.join(outer, keys).join(sizes, level1).select(*keys, level2, "_n", "_subjects", "_buckets"), [*keys, level2])
    weight = F.col("_v") / F.col("_n") / F.col("_subjects")
    bucket = F.pmod(F.xxhash64(unit), "_buckets").alias("_bucket")
    held = F.collect_list(F.struct(F.col(unit).cast("string").alias("name"), weight.alias("w")))
    arrays = weighed.groupBy(*keys, bucket).agg(held.alias("_held"))
    ready = arrays.select(*keys, "_bucket", F.col("_held.name").alias("_name"), F.col("_held.w").alias("_value"), _parts())

    def work(table: pa.Table) -> pa.Table:
        names = table.column("_name").combine_chunks()
        units = names.flatten().dictionary_encode()
        said = units.dictionary.to_pylist()
        row = np.repeat(np.arange(table.num_rows), names.value_lengths().to_numpy())
        weights = np.zeros((table.num_rows, len(said)))
        np.add.at(weights, (row, units.indices.to_numpy()), table.column("_value").combine_chunks().flatten().to_numpy())
        blocks = _range((n_perm + 127) // 128, table.column("_part")[0].as_py())
        count = max(0, min(n_perm, blocks.stop * 128) - blocks.start * 128)
        total = np.zeros((table.num_rows, len(blocks) * 128))
        for lo in range(0, len(said), 1024):
            some = slice(lo, lo + 1024)
            for i, block in enumerate(blocks):
                flipped = draws.bits([f"{seed}-sign:{block}:{u}" for u in said[some]])
                total[:, i * 128 : (i + 1) * 128] += weights[:, some] @ (1.0 - 2.0 * flipped)
        out = table.select(keys).take(np.repeat(np.arange(table.num_rows), count))
        b = np.tile(np.arange(blocks.start * 128, blocks.start * 128 + count, dtype=np.int32), table.num_rows)
        return out.append_column("b", pa.array(b)).append_column("_c", pa.array(total[:, :count].ravel()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.select(*keys).schema)
    sums = spread_out(ready, level1, "_bucket", "_part").applyInArrow(work, f"{kinds}, b int, _c double")
    nulls = sums.groupBy(*keys, "b").agg(F.sum("_c").alias("_c"))
    c, o, near = F.col("_c"), F.col("observed"), F.col("_scale") * TIE
    reached = {"greater": c >= o - near, "less": c <= o + near, "both": F.abs(c) >= F.abs(o) - near}[alternative]
    met = nulls.join(outer.select(*keys, "observed", "_scale"), keys)
    return met.groupBy(*keys).agg(F.first("observed").alias("observed"), F.avg(reached.cast("double")).alias("p"), (F.lit(1.0) / (F.count("_c") + 1)).alias("floor"))
