"""Pairs of events on the same image, their filters, and matched controls."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import distance, draw
from tessella.operators.ranking import global_rank, rank_within, running_total
from tessella.scratch import materialize


def _sides(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ij")


#: A tile's side in thresholds, and rows of a tile above which its pairs meet through cells of the threshold's size.
TILE, CROWD = 8, 512


def return_pairs(rows: DataFrame, threshold: float, group: str = "image", key: str = "fix_id", keep: tuple[str, ...] = (), least_time: float | None = None) -> DataFrame:
    """Unordered pairs of one group within ``threshold`` of each other: (group, key_i, key_j, d, kept columns of both).

    Rows are shuffled once, to their own tile and as guests to the tiles ahead whose border is
    near, and the pairs of a tile meet where it lies.  A crowded tile is dealt over as many
    tasks as it has cells.
    """
    columns = [key, "x", "y", *keep, *(["time"] if least_time is not None else [])]
    side, near = TILE * threshold, 1.01 * threshold  # guests that are too far cost a row, the distance decides
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    to_edge = lambda c, step: {0: F.lit(0.0), 1: (tile(c) + 1) * side - F.col(c), -1: F.col(c) - tile(c) * side}[step]
    at = lambda i, j: F.struct((tile("x") + i).alias("tx"), (tile("y") + j).alias("ty"), F.lit(i == j == 0).alias("own"))
    ahead = F.array_compact(F.array(at(0, 0), *[F.when((to_edge("x", i) <= near) & (to_edge("y", j) <= near), at(i, j)) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    placed = rows.select(group, *columns, F.explode(ahead).alias("_t")).select(group, "_t.*", *columns).repartition(group, "tx", "ty")
    counted = placed.withColumn("_n", F.count("*").over(Window.partitionBy(group, "tx", "ty")))

    def meet(some: DataFrame, places: tuple[Column, Column], around: DataFrame, on: list[str]) -> DataFrame:
        one = around.select(*on, "own", *[F.col(c).alias(f"{c}_1") for c in columns])
        two = some.where("own").select(group, "tx", "ty", *places, *[F.col(c).alias(f"{c}_2") for c in columns])
        return one.join(two, on).where(~F.col("own") | (F.col(f"{key}_1") < F.col(f"{key}_2"))).select(group, *[f"{c}_{s}" for c in columns for s in "12"])

    few, many = counted.where(F.col("_n") <= CROWD), counted.where(F.col("_n") > CROWD)
    cells = [F.floor(F.col(c) / threshold).cast("long") for c in "xy"]
    beside = F.array(*[F.struct((cells[0] + i).alias("cx"), (cells[1] + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    by_tile = meet(few, (), few, [group, "tx", "ty"])
    by_cell = meet(many, (cells[0].alias("cx"), cells[1].alias("cy")), many.withColumn("_c", F.explode(beside)).select("*", "_c.*"), [group, "tx", "ty", "cx", "cy"])
    met = by_tile.unionByName(by_cell)
    first = F.col(f"{key}_1") < F.col(f"{key}_2")
    sides = [F.when(first if s == "i" else ~first, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_{s}") for c in columns for s in "ij"]
    out = _with_distance(met.select(group, *sides), least_time).where(F.col("d") <= threshold)
    return out.select(group, f"{key}_i", f"{key}_j", "d", *[f"{c}_{s}" for c in keep for s in "ij"])


def _with_distance(met: DataFrame, least_time: float | None) -> DataFrame:
    out = met.withColumn("d", distance(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j")))
    return out if least_time is None else out.where(F.abs(F.col("time_i") - F.col("time_j")) >= least_time)


def all_pairs(rows: DataFrame, group: str = "image", key: str = "fix_id", keep: tuple[str, ...] = (), farther_than: float | None = None, least_time: float | None = None) -> DataFrame:
    """Unordered pairs of one group at any distance, or farther apart than given (strict)."""
    columns = [key, "x", "y", *keep, *(["time"] if least_time is not None else [])]
    i = rows.select(group, *[F.col(c).alias(f"{c}_i") for c in columns])
    j = rows.select(group, *[F.col(c).alias(f"{c}_j") for c in columns])
    met = _with_distance(i.join(j, group).where(F.col(f"{key}_i") < F.col(f"{key}_j")), least_time)
    met = met if farther_than is None else met.where(F.col("d") > farther_than)
    return met.select(group, f"{key}_i", f"{key}_j", "d", *[f"{c}_{s}" for c in keep for s in "ij"])


def different(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.where(F.col(f"{column}_i") != F.col(f"{column}_j"))


def ladder(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Nested subsets of a superset of pairs: each pair once for every threshold that it is within."""
    steps = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("d") <= t)
    return pairs.withColumn("threshold", F.explode(steps))


def symmetric(pairs: DataFrame, key: str = "fix_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each pair, as (a, b, d, kept columns of both as c_a and c_b); the pairs are made once."""
    way = lambda one, two: F.struct(F.col(f"{key}_{one}").alias("a"), F.col(f"{key}_{two}").alias("b"), "d", *[F.col(f"{c}_{s}").alias(f"{c}_{t}") for c in keep for s, t in ((one, "a"), (two, "b"))])
    return pairs.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("_w")).select("_w.*")


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each unordered pair once, smaller member first."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *rest).distinct()


def beside(moves: DataFrame, side: str, window: float, seen: str = "seen") -> DataFrame:
    """``beside``: what a move's trial looked at on one side of it, as points (x, y).

    ``seen`` lists the trial's events (ord, t0, t1, x, y).  ``side`` "current" takes what came before the
    move: events up to the from-ordinal that end within ``window`` of the from-event's end.  "previous" takes
    what came after: events from the to-ordinal on that start within ``window`` of the to-event's start.
    """
    if side == "current":
        fits = lambda e: (e["ord"] <= F.col("from_ord")) & (e["t1"] > F.col("from_end") - window)
    else:
        fits = lambda e: (e["ord"] >= F.col("to_ord")) & (e["t0"] <= F.col("to_start") + window)
    return moves.withColumn("beside", F.transform(F.filter(seen, fits), lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y")))).drop(seen)


def decorrelated(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of moves whose other sides (``beside_i`` and ``beside_j``) stay apart.

    The least distance across the two has to be ``least`` or more; a pair without events on a side is kept.
    """
    close = F.exists("beside_i", lambda p: F.exists("beside_j", lambda q: distance(p["x"], p["y"], q["x"], q["y"]) < least))
    return pairs.where(~F.coalesce(close, F.lit(False))).drop("beside_i", "beside_j")


def trial_pairs_per_bin(pairs: DataFrame, bins: list[tuple[float, float]]) -> DataFrame:
    """(bin, trial_i, trial_j): distinct trials whose paired events both overlap a time bin (start < hi, end >= lo).

    ``pairs`` has trial, trial_time and duration of both events.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(bins)])
    inside = lambda s, b: (F.col(f"trial_time_{s}") < b["hi"]) & (F.col(f"trial_time_{s}") + F.col(f"duration_{s}") >= b["lo"])
    held = F.filter(steps, lambda b: inside("i", b) & inside("j", b))
    met = pairs.where(F.col("trial_i") != F.col("trial_j")).withColumn("b", F.explode(held))
    return met.select(F.col("b.bin").alias("bin"), F.least("trial_i", "trial_j").alias("trial_i"), F.greatest("trial_i", "trial_j").alias("trial_j")).distinct()


def first_match(candidates: DataFrame, seed: str) -> DataFrame:
    """(source, match) out of candidates (a, b): for each a the first b in a seeded order; the first of each task are all that is shuffled."""
    best = F.min(F.struct(draw(seed, F.col("a"), F.col("b")).alias("_o"), "b")).alias("_m")
    return candidates.groupBy("a").agg(best).select(F.col("a").alias("source"), F.col("_m.b").alias("match"))


def matched_moves(moves: DataFrame, threshold: float, least: float, category: str, seed: str, only_large: float | None = None) -> DataFrame:
    """(source, match): for each move that lands on ``category``, a control.

    A control lands within ``threshold`` on the same image and on the same category, but comes
    from an event that has a category and not that one, and ``least`` or more away from where
    the source comes from.  The first in a seeded order is taken; sources without any are
    left out.  ``moves`` has move_id, image, x, y, fx, fy, to_category, from_category, size.
    """
    sources = moves.where(F.col("to_category") == category)
    fits = F.col("from_category_b").isNotNull() & (F.col("from_category_b") != category)
    kept = ("fx", "fy", "from_category") if only_large is None else ("fx", "fy", "from_category", "size")
    fits = fits if only_large is None else fits & (F.col("size_b") >= only_large)
    met = symmetric(return_pairs(sources, threshold, key="move_id", keep=kept), "move_id", kept)
    return first_match(met.where(fits & (distance(F.col("fx_a"), F.col("fy_a"), F.col("fx_b"), F.col("fy_b")) >= least)), seed)


#: Partners of each side that a source pair tries first; it tries ``FURTHER`` times as many in each further round.
FIRST, FURTHER = 4, 4


def _partners(sources: DataFrame, others: DataFrame, side: str, seed: str, most: int) -> DataFrame:
    """(a, b, m, r): the first ``most`` partners of one side of each source pair in draw order, within the pair's distance."""
    met = sources.select("a", "b", "d").join(others.select(F.col("a").alias(side), F.col("b").alias("m"), F.col("d").alias("_d")), side).where(F.col("_d") <= F.col("d"))
    order = Window.partitionBy("a", "b").orderBy(draw(f"{seed}-{side}", F.col("a"), F.col("b"), F.col("m")), "m")
    return met.select("a", "b", "m", F.row_number().over(order).alias("r")).where(F.col("r") <= most)


def matched_pairs(sources: DataFrame, others: DataFrame, apart: Column, seed: str) -> DataFrame:
    """(a, b, m0, m1): for a source pair a partner of a and a partner of b out of other pairs.

    Both are taken from ``others`` (a, b, d; both directions).  m0 and m1 differ, are no
    source pair themselves, and are within the source's distance ``d`` on the matched
    side.  ``apart`` (over a, b, m0, m1 and the columns of ``sources``) has to hold, too.  A
    source pair without any such couple is dropped.

    The partners of each side have a drawn order, and the couple whose later partner comes
    first is taken (then the earlier one of a, then of b).  Couples are tried by rounds: only the first
    few partners of both sides meet, and only source pairs that are still without a couple
    and have further partners go on with more of them.
    """
    columns, still, found, tried, most = sources.columns, materialize(sources, "sources"), None, 0, FIRST
    known = symmetric(still.select(F.col("a").alias("p_i"), F.col("b").alias("p_j"), "d"), "p").select(F.col("a").alias("m0"), F.col("b").alias("m1"))
    others = materialize(others.select("a", "b", "d"), "others")
    while True:
        one, two = (_partners(still, others, side, seed, most) for side in ("a", "b"))
        sides = materialize(one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1))), "partners")
        of = lambda k: sides.where(F.col("side") == k).select("a", "b", F.col("m").alias(f"m{k}"), F.col("r").alias(f"r{k}"))  # noqa: B023, E731
        met = still.join(of(0), ["a", "b"]).join(of(1), ["a", "b"]).where(F.greatest("r0", "r1") > tried)
        met = met.where((F.col("m0") != F.col("m1")) & apart).join(known, ["m0", "m1"], "left_anti")
        best = F.min_by(F.struct("m0", "m1"), F.struct(F.greatest("r0", "r1"), "r0", "r1")).alias("_m")
        here = materialize(met.groupBy("a", "b").agg(best).select("a", "b", "_m.m0", "_m.m1"), "couples")
        found = here if found is None else found.unionByName(here)
        full = sides.where(F.col("r") == most).select("a", "b").distinct()  # others have been tried whole
        still = materialize(still.join(full, ["a", "b"], "left_semi").join(here, ["a", "b"], "left_anti").select(*columns), "sources")
        if still.isEmpty():
            return found
        tried, most = most, most * FURTHER


#: Pairs are listed where they are at most so many times as many as are asked for, else drawn.
LISTED = 16


def pair_at(t: Column) -> tuple[Column, Column]:
    """The two members i < j of the unordered pair number ``t``: pairs are numbered by j, then by i."""
    guess = F.floor((F.sqrt(8.0 * t + 1) + 1) / 2).cast("long")
    before = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(before(guess) > t, guess - 1).when(before(guess + 1) <= t, guess + 1).otherwise(guess)  # the root may round
    return t - before(j), j


def sample_pairs(rows: DataFrame, most: int, seed: str, fits: Column, group: str = "image", key: str = "fix_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, key_i, key_j, d, kept columns of both): ``most`` of the unordered pairs of one group that fit, without listing all.

    Pairs have numbers; draws are hashed numbers, decoded to two rows, and rejected where
    ``fits`` (over d and the kept columns) doesn't hold.  The first ``most`` distinct ones in the order of the draws are
    taken, so the cost is that of the draws, however many pairs a group has.  Where all pairs are not many more than asked for, or too
    few of the draws fit, all pairs are listed and the first in a drawn order are taken.
    """
    columns = [key, "x", "y", *[c for c in keep if c not in (key, "x", "y")]]
    placed = materialize(rank_within(rows.select(group, *columns), [group], [key], "_k").withColumn("_k", F.col("_k") - 1), "pair-rows")
    groups = placed.groupBy(group).agg(F.expr("count(*) * (count(*) - 1) div 2").alias("_p")).where("_p > 0")
    numbered = global_rank(groups, [group], "_g")
    total = groups.agg(F.sum("_p")).first()[0] or 0
    listed = total <= LISTED * most
    drawn, n = 0, 2 * most
    if not listed:
        ends = materialize(running_total(numbered, "_g", "_p", "_end"), "pair-groups")
    while not listed:
        numbers = np.array([int(md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) % total for i in range(n)], np.int64)  # in proportion to the pairs asked for
        order = np.argsort(numbers, kind="stable")
        at = numbers[order]

        def mine(batches: Iterator[pa.RecordBatch], at: np.ndarray = at, order: np.ndarray = order) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                end, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                lo, hi = np.searchsorted(at, end - size), np.searchsorted(at, end)
                row = np.repeat(np.arange(len(end)), hi - lo)
                pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True) if a < b] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at[pick] - (end - size)[row]), pa.array(order[pick])], names=[group, "_t", "_i"])

        kind = rows.schema[group].dataType.simpleString()
        hits = ends.select(group, "_end", "_p").mapInArrow(mine, f"`{group}` {kind}, _t long, _i long").groupBy(group, "_t").agg(F.min("_i").alias("_i"))
        i, j = pair_at(F.col("_t"))
        hits = hits.select(group, "_i", i.alias("_ki"), j.alias("_kj"))
        for s in "ij":
            hits = hits.join(placed.select(group, F.col("_k").alias(f"_k{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]), [group, f"_k{s}"])
        good = materialize(_with_distance(hits, None).where(fits), "drawn-pairs")
        drawn = good.count()
        if drawn >= most:
            return good.orderBy("_i").limit(most).select(group, f"{key}_i", f"{key}_j", "d", *[f"{c}_{s}" for c in keep for s in "ij"])
        n *= 4
        listed = n > total
    every = all_pairs(rows, group, key, keep).where(fits)
    return every.orderBy(draw(seed, F.col(f"{key}_i"), F.col(f"{key}_j")), f"{key}_i", f"{key}_j").limit(most)


def one_sided_match(pairs: DataFrame, least: float, seed: str) -> DataFrame:
    """(source, match): a partner (of pairs a, b in both directions) that is ``least`` or more away on the unmatched side.

    ``ux`` and ``uy`` of both (ux_a, ux_b, ...) are where each event is on that side.
    """
    return first_match(pairs.where(distance(F.col("ux_a"), F.col("uy_a"), F.col("ux_b"), F.col("uy_b")) >= least), seed)
