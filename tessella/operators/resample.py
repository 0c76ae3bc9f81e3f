"""Tests of pairs by bootstraps and permutations whose draws are hashes, so any engine repeats them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tessella.functions import draws
from tessella.functions.scalars import draw
from tessella.operators.ranking import global_rank
from tessella.scratch import materialize

#: Pairs of a condition that resampling uses at most; above it a seeded subset stands for all.
MAX_PAIRS = 10_000


# -- p-values


def p_value(sample: Column, null: Column, alternative: str = "greater") -> Column:
    """1 - the share of replicates with sample beyond null, floored at 1 / (1 + replicates); ties count toward p.

    NULL replicates are left out, and without any the p-value is NULL.
    """
    beyond = {"greater": sample - null, "less": null - sample, "two-sided": F.abs(sample) - F.abs(null)}[alternative]
    n = F.count(beyond)
    p = F.lit(1.0) - F.try_divide(F.count_if(beyond > 0).cast("double"), n)
    return F.when(n > 0, F.greatest(p, F.lit(1.0) / (n + 1)))


def p_value_difference(sample: Column, null: Column, alternative: str = "two-sided") -> Column:
    """As ``p_value``, for a statistic that is condition 1 - condition 0: "greater" asks whether condition 0 is."""
    turned = {"greater": "less", "less": "greater", "two-sided": "two-sided"}
    return p_value(sample, null, turned[alternative])


# -- pairs


def capped(pairs: DataFrame, ids: list[str], seed: str, most: int = MAX_PAIRS, by: list[str] | None = None) -> DataFrame:
    """At most ``most`` pairs (of each group), the first in a seeded order."""
    if by:
        w = Window.partitionBy(*by).orderBy(draw(seed, *[F.col(c) for c in ids]), *ids)
        return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return pairs.orderBy(draw(seed, *[F.col(c) for c in ids]), *ids).limit(most)


def numbered(pairs: DataFrame, ids: list[str], by: list[str] | None = None) -> DataFrame:
    """``k`` from 0 and ``n``: the pairs' places and number; meant for capped pairs."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return pairs.withColumn("k", F.row_number().over(w.orderBy(*ids)) - 1).withColumn("n", F.count("*").over(w))


def unit_values(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """The columns of pairs (k, n, i, j) with both responses of each unit, a and b; every unit has the same pairs.

    Pairs are capped, so their events (twice ``MAX_PAIRS`` pairs at most) go to the responses and no other response is shuffled.
    """
    pairs = materialize(pairs, "capped-pairs")
    events = pairs.select(F.explode(F.array("i", "j")).alias("event")).distinct()
    responses = responses.join(F.broadcast(events), "event", "left_semi")
    ri = responses.select(F.col("event").alias("i"), "unit", F.col("resp").cast("double").alias("a"))
    rj = responses.select(F.col("event").alias("j"), "unit", F.col("resp").cast("double").alias("b"))
    return pairs.join(ri, "i").join(rj, ["j", "unit"])


#: Units whose replicates a task computes together.
UNITS_PER_BLOCK = 64
#: Pairs of a unit's row, pairs that are correlated at once, and pairs times units that a task holds (but one unit at least).
SEGMENT, BLOCK, HELD = 1 << 12, 1 << 16, 1 << 24


def _draws(seed: str, n: int, *keys: int) -> np.ndarray:
    """``scalars.draw`` of the seed, the keys and each place up to n."""
    return draws.first_words(":".join(map(str, (seed, *keys))) + ":", 0, n).astype(np.int64)


def _places(draws: np.ndarray) -> np.ndarray:
    """The rank from 0 of each draw; equal draws rank in their order."""
    out = np.empty(len(draws), np.int64)
    out[np.argsort(draws, kind="stable")] = np.arange(len(draws))
    return out


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row the correlation of what both have, clipped to [-1, 1]; NaN below two values or without variance."""
    ok = np.isfinite(x) & np.isfinite(y)
    n = np.maximum(ok.sum(1), 1)[:, None]
    centred, flat = [], ok.sum(1) < 2
    for v in (x, y):
        here = np.where(ok, v, 0.0)
        flat |= (np.where(ok, v, -np.inf).max(1, initial=-np.inf) == np.where(ok, v, np.inf).min(1, initial=np.inf))
        centred.append(np.where(ok, here - here.sum(1, keepdims=True) / n, 0.0))
    a, b = centred
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(flat, np.nan, np.clip(r, -1, 1))


class _Block:
    """Units of a block as matrices: a row for each unit, a column for each pair; NaN where a unit lacks a pair."""

    def __init__(self, table: pa.Table) -> None:
        self.units = table.column("unit").combine_chunks()
        self.n = int(table.column("n")[0].as_py())
        lists = {c: table.column(c).combine_chunks() for c in table.column_names if pa.types.is_list(table.schema.field(c).type)}
        sizes = lists["k"].value_lengths().to_numpy()
        self.counts = sizes
        self._at = np.repeat(np.arange(len(sizes)), sizes), lists["k"].flatten().to_numpy()
        self._lists = lists

    def __getitem__(self, name: str) -> np.ndarray:
        out = np.full((len(self.units), self.n), np.nan)
        out[self._at] = self._lists[name].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return out


def _by_blocks(values: DataFrame, columns: list[str], n_units: int, n_replicates: int, work, schema: str) -> DataFrame:
    """``work`` (a block and a range of replicates to a table) for every block of units and block of replicates.

    The capped pairs of a unit are two arrays; a task holds ``UNITS_PER_BLOCK`` units and draws
    its replicates itself, so nothing is shuffled for a replicate.
    """
    spark = values.sparkSession
    unit_blocks = n_units // UNITS_PER_BLOCK + 1
    parts = max(1, min(n_replicates, 2 * spark.sparkContext.defaultParallelism // unit_blocks))
    met = F.array_sort(F.collect_list(F.struct("k", *columns)))
    units = values.groupBy("unit").agg(F.first("n").alias("n"), met.alias("_p")).select("unit", "n", *[F.col(f"_p.{c}").alias(c) for c in ["k", *columns]])
    first = F.pmod(F.xxhash64("unit"), F.lit(unit_blocks)).cast("int") * parts
    dealt = units.withColumn("_part", F.explode(F.sequence(first, first + (parts - 1)))).repartitionById(unit_blocks * parts, F.col("_part"))  # a task for each block, however small

    def run(table: pa.Table) -> pa.Table:
        part = int(table.column("_part")[0].as_py()) % parts
        return work(_Block(table), range(n_replicates * part // parts, n_replicates * (part + 1) // parts))

    return dealt.groupBy("_part").applyInArrow(run, schema)


def _beyond(sample: np.ndarray, null: np.ndarray, alternative: str) -> np.ndarray:
    return {"greater": lambda: sample - null, "less": lambda: null - sample, "two-sided": lambda: np.abs(sample) - np.abs(null)}[alternative]() > 0


def _floored(beyond: str, n: str) -> Column:
    """The p-value of counted replicates, as ``p_value`` gives it."""
    total = F.sum(n)
    return F.when(total > 0, F.greatest(F.lit(1.0) - F.sum(beyond) / total, F.lit(1.0) / (total + 1)))


def _number(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _ranks(seed: str, n: int, *keys: int) -> np.ndarray:
    """The rank from 0 of each place's draw among all n; equal draws rank in their order."""
    said, order = ":".join(map(str, (seed, *keys))) + ":", np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        order[lo:hi] = draws.first_words(said, lo, hi).astype(np.uint64) << np.uint64(32) | np.arange(lo, hi, dtype=np.uint64)
    order.sort()
    out = np.empty(n, np.uint32)
    for lo in range(0, n, BLOCK):
        out[(order[lo : lo + BLOCK] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.arange(lo, min(n, lo + BLOCK), dtype=np.uint32)
    return out


def _odd(said: str, lo: int, hi: int) -> np.ndarray:
    return draws.first_words(said, lo, hi) & np.uint32(1)


def _drawn_sides(n: int, size: type, flip: str, at: str | None = None) -> np.ndarray:
    """A row (2k or 2k + 1) of each pair k in order, or, with ``at``, of as many drawn pairs; block by block, so few numbers are there besides."""
    out = np.empty(n, size)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        pair = np.arange(lo, hi) if at is None else draws.first_words(at, lo, hi).astype(np.int64) % n
        out[lo:hi] = 2 * pair + _odd(flip, lo, hi)
    return out


def _drawn_correlations(held: np.ndarray, one: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """By unit (column of ``held``) the correlation of the rows ``one`` with those beside them, in the order of ``rank``.

    Many rows are added up block by block, around the unit's middle.
    """
    sides = lambda some: [np.ascontiguousarray(held[rows].T) for rows in (one[some], (one[some] if rank is None else one[rank[some]]) ^ 1)]
    n = len(one)
    if n <= BLOCK:
        return correlations(*sides(slice(0, n)))
    first = held[:BLOCK]
    middle = (np.nansum(first, 0) / np.maximum(np.isfinite(first).sum(0), 1))[:, None]
    sums = np.zeros((6, held.shape[1]))
    for lo in range(0, n, BLOCK):
        x, y = (v - middle for v in sides(slice(lo, lo + BLOCK)))
        ok = np.isfinite(x + y)
        if not ok.all():
            x, y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
        sums += [ok.sum(1), x.sum(1), y.sum(1), *(np.einsum("ur,ur->u", v, w) for v, w in ((x, x), (y, y), (x, y)))]
    m, sx, sy, xx, yy, xy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = xx - sx * sx / m, yy - sy * sy / m
        r = np.clip((xy - sx * sy / m) / np.sqrt(vx * vy), -1, 1)
    return np.where((m >= 2) & (vx > xx * 1e-13) & (vy > yy * 1e-13), r, np.nan)  # without variance up to rounding


def self_consistency(pairs: DataFrame, responses: DataFrame, n_boot: int, n_perm: int, seed: str, alternative: str = "greater") -> DataFrame:
    """``value_consistency`` of pairs (k, n, i, j) that the caller has capped, with each unit's responses to their members."""
    return value_consistency(unit_values(pairs, responses), n_boot, n_perm, seed, alternative)


def value_consistency(values: DataFrame, n_boot: int, n_perm: int, seed: str, alternative: str = "greater") -> DataFrame:
    """Per unit: n, r, boot_mean, boot_sd, p.

    ``values`` is (unit, k, a, b), the responses to both members of each pair, of any number; pairs are numbered from 0, and there
    are ``n`` if the column is there.  The sides of each pair are swapped at random in each
    replicate; bootstrap replicates draw pairs with replacement, the null re-pairs second
    members.  Draws leave the unit out, so all units share them.  With fewer than two pairs
    the statistics are NULL.

    A task has some replicates of some units: all units if ``HELD`` allows, else one at least, whose pairs it holds whole
    (16 bytes a pair, and 12 to 16 for a replicate's draws), as a replicate pairs any with any.
    """
    spark = values.sparkSession
    number = F.first("n") if "n" in values.columns else F.max("k") + 1
    gathered = values.where("unit IS NOT NULL").groupBy("unit", F.expr(f"k div {SEGMENT}").alias("_s")).agg(number.alias("n"), F.collect_list(F.struct("k", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))).alias("_p"))
    segments = materialize(gathered.select("unit", "n", *[F.col(f"_p.{c}").alias(c) for c in "kab"]), "pair-segments")
    numbered = materialize(global_rank(segments.select("unit").distinct(), ["unit"], "_r"), "units")
    n, n_units = segments.agg(F.max("n")).first()[0] or 0, numbered.count()
    per_block = max(1, min(UNITS_PER_BLOCK, HELD // max(n, 1)))
    n_blocks, n_replicates = max(1, -(-n_units // per_block)), n_boot + n_perm
    parts = max(1, min(n_replicates, -(-spark.sparkContext.defaultParallelism // n_blocks)))
    placed = segments.join(numbered, "unit").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = placed.select("unit", "k", "a", "b", F.expr(f"(_r - 1) % {per_block}").cast("int").alias("_u"), F.expr(f"(_r - 1) div {per_block} * {parts} + _part").cast("int").alias("_id")).repartitionById(n_blocks * parts, F.col("_id"))
    kind = to_arrow_type(values.schema["unit"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is None and batch.num_rows:
                block, part = divmod(batch.column("_id")[0].as_py(), parts)
                units: list = [None] * min(per_block, n_units - block * per_block)
                held, counts = np.full((2 * n, len(units)), np.nan), np.zeros(len(units), np.int64)
            for u, name, k, x, y in zip(batch.column("_u").to_pylist(), batch.column("unit").to_pylist(), *(batch.column(c) for c in "kab"), strict=True):
                units[u], at = name, k.values.to_numpy()
                counts[u] += len(at)
                for side, v in enumerate((x, y)):  # a pair's two sides are beside each other
                    held[2 * at + side, u] = v.values.to_numpy(zero_copy_only=False)
        if held is None:
            return
        size = np.uint32 if n < 1 << 31 else np.int64
        r = _drawn_correlations(held, _drawn_sides(n, size, f"{seed}-side:"))
        sums = np.zeros((5, len(r)))  # bootstraps: number, sum, sum of squares; nulls: number, beyond
        for i in range(part, n_replicates, parts):
            if i < n_boot:
                found = _drawn_correlations(held, _drawn_sides(n, size, f"{seed}-boot-side:{i}:", f"{seed}-boot:{i}:"))
                ok = np.isfinite(found)
                sums[:3] += [ok, np.where(ok, found, 0), np.where(ok, found * found, 0)]
            else:
                rank = _ranks(f"{seed}-perm", n, i - n_boot)
                found = _drawn_correlations(held, _drawn_sides(n, size, f"{seed}-perm-side:{i - n_boot}:"), rank)
                ok = np.isfinite(found) & np.isfinite(r)
                sums[3:] += [ok, ok & _beyond(r, found, alternative)]
        yield pa.RecordBatch.from_arrays([pa.array(units, kind), pa.array(counts), pa.array(r), *map(pa.array, sums)], names=["unit", "n", "r", "bn", "bs", "bq", "pn", "pb"])

    done = dealt.mapInArrow(work, f"unit {values.schema['unit'].dataType.simpleString()}, n long, r double, bn double, bs double, bq double, pn double, pb double")
    mean = F.try_divide(F.sum("bs"), F.sum("bn"))
    sd = F.when(F.sum("bn") > 0, F.sqrt(F.greatest(F.try_divide(F.sum("bq"), F.sum("bn")) - mean * mean, F.lit(0.0))))
    return done.groupBy("unit").agg(F.first("n").alias("n"), _number(F.first("r")).alias("r"), mean.alias("boot_mean"), sd.alias("boot_sd"), _floored("pb", "pn").alias("p"))


def two_condition_test(pairs: DataFrame, responses: DataFrame, n_perm: int, seed: str, alternative: str = "two-sided", paired: bool = False) -> DataFrame:
    """Per unit: r0, r1, p of the difference r1 - r0.

    ``pairs`` is (k, n, i, j, cond) with cond 0 or 1, as ``subsampled`` leaves them.  Sides are swapped at
    random in each replicate; labels are shuffled over all pairs, or, ``paired``, swapped within
    couples (a column ``couple``, a number).
    """
    labels = ["cond", "couple"] if paired else ["cond"]
    n0 = F.sum(F.when(F.col("cond") == 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    counted = pairs.withColumn("n0", n0)  # twice ``MAX_PAIRS`` rows at most

    def of(label: np.ndarray, c: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return correlations(np.where(label == c, x, np.nan), np.where(label == c, y, np.nan))

    def work(block: _Block, replicates: range) -> pa.Table:
        a, b, n, cond = block["a"], block["b"], block.n, block["cond"]
        zeros = int(np.nanmax(block["n0"]))
        flip = _draws(f"{seed}-side", n) % 2 == 1
        r0, r1 = (of(cond, c, np.where(flip, b, a), np.where(flip, a, b)) for c in (0, 1))
        held = np.zeros((2, len(r0)))
        for i in replicates:
            flip = _draws(f"{seed}-label-side", n, i) % 2 == 1
            if paired:
                couple = np.nan_to_num(block["couple"]).astype(np.int64)
                names = np.unique(couple)
                swap = np.array([int.from_bytes(md5(f"{seed}-swap:{i}:{c}".encode()).digest()[:4], "big") % 2 for c in names])[np.searchsorted(names, couple)]
                label = np.where(swap == 1, 1 - cond, cond)
            else:
                label = (_places(_draws(f"{seed}-label", n, i)) >= zeros)[None, :]
            x, y = np.where(flip, b, a), np.where(flip, a, b)
            found = of(label, 1, x, y) - of(label, 0, x, y)
            ok = np.isfinite(found) & np.isfinite(r1 - r0)
            turned = {"greater": "less", "less": "greater", "two-sided": "two-sided"}[alternative]
            held += [ok, ok & _beyond(r1 - r0, found, turned)]
        return pa.table([block.units, pa.array(r0), pa.array(r1), *map(pa.array, held)], names=["unit", "r0", "r1", "pn", "pb"])

    kind = responses.schema["unit"].dataType.simpleString()
    n_units = responses.agg(F.approx_count_distinct("unit")).first()[0]
    done = _by_blocks(unit_values(counted, responses), ["a", "b", "n0", *labels], n_units, n_perm, work, f"unit {kind}, r0 double, r1 double, pn double, pb double")
    return done.groupBy("unit").agg(_number(F.first("r0")).alias("r0"), _number(F.first("r1")).alias("r1"), _floored("pb", "pn").alias("p"))


def subsample_sizes(n0: int, n1: int, most: int = MAX_PAIRS) -> tuple[int, int]:
    """Sizes of two conditions that are shrunk together to 2 * ``most`` pairs.

    The smaller shrinks with the square root of what it has beyond two pairs, on the curve
    on which two conditions of equal size keep ``most`` each; the larger takes the rest.
    """
    if n0 + n1 <= 2 * most:
        return n0, n1
    small = min(n0, n1)
    slope = (most - 2) / ((n0 + n1) / 2 - 2) ** 0.5
    kept = min(round(2 + slope * (small - 2) ** 0.5), small)
    return (kept, 2 * most - kept) if n0 <= n1 else (2 * most - kept, kept)


def subsample_size_columns(n0: Column, n1: Column, most: int = MAX_PAIRS) -> tuple[Column, Column]:
    """``subsample_sizes`` for columns."""
    small, total = F.least(n0, n1), n0 + n1
    slope = F.lit(float(most - 2)) / F.sqrt(total / 2 - 2)
    kept = F.least(F.rint(2 + slope * F.sqrt((small - 2).cast("double"))).cast("long"), small)
    fits = total <= 2 * most
    first = F.when(fits, n0).when(n0 <= n1, kept).otherwise(2 * most - kept)
    return first, F.when(fits, n1).otherwise(2 * most - first)


def subsampled(pairs: DataFrame, ids: list[str], seed: str, most: int = MAX_PAIRS) -> DataFrame:
    """Pairs of two conditions (``cond`` 0 or 1), each shrunk to its size by ``subsample_sizes``, the first in a seeded order."""
    pairs = materialize(pairs.select(*ids, "cond"), "pairs")
    sizes = {r["cond"]: r["count"] for r in pairs.groupBy("cond").count().collect()}  # two rows
    kept = subsample_sizes(sizes.get(0, 0), sizes.get(1, 0), most)
    if kept == (sizes.get(0, 0), sizes.get(1, 0)):
        return pairs
    zero, one = (capped(pairs.where(F.col("cond") == c), ids, seed, kept[c]) for c in (0, 1))
    return zero.unionByName(one)
