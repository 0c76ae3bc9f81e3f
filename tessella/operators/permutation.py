"""Permutation tests over rows, without a row for each replicate.

A replicate is a keyed bijection of a group's places (``draws.places``), so nothing is
sorted or joined for it: the task that holds a group's values as arrays looks its partners up.
Groups that one task can hold are tested there; larger ones are held in chunks,
whose sums are added up by replicate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import draws
from tessella.functions.moments import pearson
from tessella.operators.ranking import rank_within, spread_out
from tessella.scratch import materialize

#: Rows of a group that one task holds, and rows that a task works through.
CHUNK = 1 << 18
#: Tasks over which replicates are dealt.
PARTS = 8
#: Numbers of a block of replicates and places.
AT_ONCE = 1 << 16
#: Numbers of bijections that are kept for further groups of one size, and sizes of which they are.
KEPT, MOST_KEPT = 1 << 18, 64
#: Replicates nearer to the observed value than this tie with it, so sums may round.
TIE = 1e-9


def _replicates(n_perm: int, part: int) -> range:
    return range(n_perm * part // PARTS, n_perm * (part + 1) // PARTS)


def _dealt(chunks: DataFrame, n_rows: int, block: Column) -> DataFrame:
    """Chunks with the block of work that they fall to, for every part of the replicates."""
    blocks = n_rows // CHUNK + 1
    return chunks.withColumn("_block", F.pmod(block, F.lit(blocks))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _rows(table: pa.Table) -> list[dict]:
    """The rows with their arrays as numpy arrays."""
    plain = [c for c in table.column_names if not pa.types.is_list(table.schema.field(c).type)]
    out = table.select(plain).to_pylist()
    for c in set(table.column_names) - set(plain):
        lists = table.column(c)
        for i, row in enumerate(out):
            row[c] = lists[i].values.to_numpy(zero_copy_only=False)
    return out


class _Places:
    """Bijections of a task's replicates; those of small groups are made once for each size."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self._made = keys, {}

    def sums(self, n: int, first: int, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``work`` over blocks of replicates of where ``size`` places from ``first`` go, joined."""
        if n * len(self.keys) <= KEPT:
            if n not in self._made:
                if len(self._made) == MOST_KEPT:
                    self._made.clear()
                self._made[n] = draws.places(self.keys, n)
            return work(self._made[n][:, first : first + size])
        step = max(1, AT_ONCE // size)
        return np.concatenate([work(draws.places(self.keys[lo : lo + step], n, first, first + size)) for lo in range(0, len(self.keys), step)])


def _outcome(table: pa.Table, by: list[str], row: list[int], columns: dict[str, list | np.ndarray]) -> pa.Table:
    out = table.select(by).take(pa.array(row, pa.int64()))
    for name, x in columns.items():
        out = out.append_column(name, pa.array(x, pa.float64() if name == "s" else pa.int64()))
    return out


def _p(reached: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.greatest(F.col(reached) / F.col(n), F.lit(1.0) / (F.col(n) + 1)))


def corr_perm_test(rows: DataFrame, n_perm: int, seed: str, by: list[str], key: str, x: str = "x", y: str = "y", alternative: str = "greater") -> DataFrame:
    """Per group: r, p of the correlation against a permuted y.

    Rows without both values are left out; all groups share the keys of the bijections.  With fewer than two
    rows, or without variance, r and p are NULL.
    """
    values = rows.select(*by, F.col(key).alias("_key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    placed = materialize(rank_within(values, by, ["_key", "x", "y"], "k").drop("_key"), "perm-rows")
    centred = lambda a, b: F.regr_sxy(a, b) if a != b else F.regr_sxx(a, a)
    groups = placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (centred("x", "x") * centred("y", "y")).alias("ss"), pearson(F.col("x"), F.col("y")).alias("r"))
    tested = placed.join(groups.where("r IS NOT NULL"), by).withColumn("k", F.col("k") - 1).withColumn("x", F.col("x") - F.col("mx")).withColumn("y", (F.col("y") - F.col("my")) / F.sqrt("ss"))
    held = F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("held")
    chunks = tested.groupBy(*by, "n", "r", F.expr(f"k div {CHUNK}").alias("chunk")).agg(held)
    mine = chunks.select(*by, "n", "r", "chunk", F.col("held.x").alias("x"))
    other = chunks.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("chunk").alias("other"), F.col("held.y").alias("y"))
    pairs = mine.join(other, [F.col(c) == F.col(f"_{c}") for c in by]).drop(*[f"_{c}" for c in by])  # a group of one chunk meets itself only
    dealt = _dealt(pairs, placed.count(), F.xxhash64(*by, "chunk", "other"))

    def reached(null: np.ndarray, r: float) -> np.ndarray:
        return {"greater": lambda: null >= r - TIE, "less": lambda: null <= r + TIE, "two-sided": lambda: np.abs(null) >= abs(r) - TIE}[alternative]()

    def work(table: pa.Table) -> pa.Table:
        block = _replicates(n_perm, table.column("_part")[0].as_py())
        bijections = _Places(draws.bijection_keys(seed, block))
        at: list[int] = []
        out: dict[str, list] = {"reached": [], "b": [], "s": []}
        for i, row in enumerate(_rows(table)):
            first, start = row["chunk"] * CHUNK, row["other"] * CHUNK
            ys = np.append(row["y"], 0.0)
            whole = row["n"] <= CHUNK

            def null(to: np.ndarray, row: dict = row, start: int = start, ys: np.ndarray = ys, whole: bool = whole) -> np.ndarray:
                if not whole:
                    to = np.where((to >= start) & (to < start + len(row["y"])), to.astype(np.int64) - start, len(row["y"]))
                return ys[to] @ row["x"]

            found = bijections.sums(row["n"], first, len(row["x"]), null)
            if whole:
                at.append(i)
                out["reached"].append(int(reached(found, row["r"]).sum()))
                out["b"].append(None)
                out["s"].append(None)
            else:
                at += [i] * len(found)
                out["reached"] += [None] * len(found)
                out["b"] += list(block)
                out["s"] += found.tolist()
        return _outcome(table, by, at, out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*by).schema)
    done = materialize(spread_out(dealt, "_block", "_part").applyInArrow(work, f"{kinds}, reached long, b long, s double"), "perm-sums")
    split = done.where("b IS NOT NULL").groupBy(*by, "b").agg(F.sum("s").alias("s")).join(groups.select(*by, "r"), by)
    s, r = F.col("s"), F.col("r")
    beyond = {"greater": s >= r - TIE, "less": s <= r + TIE, "two-sided": F.abs(s) >= F.abs(r) - TIE}[alternative]
    counted = done.where("b IS NULL").groupBy(*by).agg(F.sum("reached").alias("reached")).unionByName(split.groupBy(*by).agg(F.count_if(beyond).alias("reached")))
    return groups.select(*by, "r").join(counted.withColumn("n", F.lit(n_perm)), by, "left").select(*by, "r", _p("reached", "n").alias("p"))


def index_perm_test(rows: DataFrame, n_perm: int, seed: str, unit: str, key: str, condition: Column, category: Column, value: str) -> DataFrame:
    """Per unit: the selectivity index of two conditions, their difference, and its p-value.

    In each replicate the rows of a category are dealt anew to the two conditions, so many to each as
    before: those whose bijection takes them below the number of condition 0.  Rows without a value are left
    out; ties count toward p, and without both indices p is NULL.
    """
    base = rows.select(unit, F.col(key).alias("_key"), condition.cast("int").alias("cond"), category.alias("cat"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND cond IN (0, 1) AND cat IS NOT NULL")
    mean = lambda c, a: F.avg(F.when((F.col("cond") == c) & (F.col("cat") == a), F.col("v")))
    index = lambda c: F.try_divide(mean(c, True) - mean(c, False), mean(c, True) + mean(c, False))
    units = base.groupBy(unit).agg(index(0).alias("index0"), index(1).alias("index1"), F.count_if("cat").alias("n_in"), F.count_if(~F.col("cat")).alias("n_out"))
    placed = materialize(rank_within(base, [unit, "cat"], ["_key", "cond", "v"], "k").drop("_key"), "perm-rows")
    sizes = placed.groupBy(unit, "cat").agg(F.count("*").alias("n"), F.count_if(F.col("cond") == 0).alias("n0"), F.sum("v").alias("total"))
    tested = units.where("index0 IS NOT NULL AND index1 IS NOT NULL").withColumn("d", F.abs(F.col("index1") - F.col("index0"))).withColumn("whole", F.greatest("n_in", "n_out") <= CHUNK)
    chunk = F.expr(f"(k - 1) div {CHUNK}").alias("chunk")
    arrays = placed.join(sizes, [unit, "cat"]).groupBy(unit, "cat", "n", "n0", "total", chunk).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("held"))
    chunks = arrays.join(tested.select(unit, "d", "whole"), unit).select(unit, "cat", "n", "n0", "total", "chunk", "d", "whole", F.col("held.v").alias("v"))
    dealt = _dealt(chunks, placed.count(), F.xxhash64(unit, "chunk"))

    def split(zeros: np.ndarray | Column, row) -> tuple:
        """The means of both conditions from the sum of condition 0."""
        return zeros / row["n0"], (row["total"] - zeros) / (row["n"] - row["n0"])

    def work(table: pa.Table) -> pa.Table:
        block = _replicates(n_perm, table.column("_part")[0].as_py())
        bijections = _Places(draws.bijection_keys(seed, block))
        at: list[int] = []
        out: dict[str, list] = {"n": [], "reached": [], "cat": [], "b": [], "s": []}
        half: dict[object, tuple[dict, np.ndarray]] = {}
        for i, row in enumerate(_rows(table)):
            found = bijections.sums(row["n"], row["chunk"] * CHUNK, len(row["v"]), lambda to, row=row: (to < row["n0"]) @ row["v"])
            if not row["whole"]:
                at += [i] * len(found)
                out["n"] += [None] * len(found)
                out["reached"] += [None] * len(found)
                out["cat"] += [int(row["cat"])] * len(found)
                out["b"] += list(block)
                out["s"] += found.tolist()
            elif row[unit] not in half:
                half[row[unit]] = row, found
            else:
                one, other = split(found, row), split(half[row[unit]][1], half[row[unit]][0])
                with np.errstate(all="ignore"):
                    d = np.abs((one[1] - other[1]) / (one[1] + other[1]) - (one[0] - other[0]) / (one[0] + other[0]))
                ok = np.isfinite(d)
                at.append(i)
                for c, x in (("n", int(ok.sum())), ("reached", int((d[ok] >= row["d"] - TIE).sum())), ("cat", None), ("b", None), ("s", None)):
                    out[c].append(x)
        return _outcome(table, [unit], at, out)

    kind = base.schema[unit].dataType.simpleString()
    done = materialize(spread_out(dealt, "_block", "_part").applyInArrow(work, f"`{unit}` {kind}, n long, reached long, cat long, b long, s double"), "perm-sums")
    each = done.where("b IS NOT NULL").groupBy(unit, F.col("cat").cast("boolean").alias("cat"), "b").agg(F.sum("s").alias("s")).join(sizes, [unit, "cat"])
    zero, one = split(F.col("s"), {c: F.col(c) for c in ("n", "n0", "total")})
    of = lambda x, a: F.max(F.when(F.col("cat") == a, x))
    drawn = lambda x: F.try_divide(of(x, True) - of(x, False), of(x, True) + of(x, False))
    nulls = each.groupBy(unit, "b").agg(F.abs(drawn(one) - drawn(zero)).alias("d_0")).join(tested.select(unit, "d"), unit)
    large = nulls.groupBy(unit).agg(F.count("d_0").alias("n"), F.count_if(F.col("d_0") >= F.col("d") - TIE).alias("reached"))
    counted = done.where("b IS NULL").groupBy(unit).agg(F.sum("n").alias("n"), F.sum("reached").alias("reached")).unionByName(large)
    return units.select(unit, "index0", "index1").join(counted, unit, "left").select(unit, "index0", "index1", _p("reached", "n").alias("p"))
