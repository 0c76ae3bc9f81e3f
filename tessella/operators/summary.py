"""Region summaries: unit selection, nested centres with spreads and corrected tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import nested, tests


@dataclass(frozen=True)
class StatTest:
    """Condition 0 against condition 1 (None: against 0)."""

    cond0: str
    cond1: str | None = None
    alternative: str = "both"

    @property
    def name(self) -> str:
        return f"{self.cond0}-{self.cond1}" if self.cond1 else self.cond0

    def ordered(self, conditions: list[str]) -> StatTest:
        """The same test with its conditions in a given order; the alternative turns with them."""
        if self.cond1 is None or conditions.index(self.cond0) <= conditions.index(self.cond1):
            return self
        turned = {"greater": "less", "less": "greater"}.get(self.alternative, self.alternative)
        return StatTest(self.cond1, self.cond0, turned)


def without_rare(units: DataFrame, least_share: float = 0.05, level1: str = "region", level2: str = "subject") -> DataFrame:
    """Without subjects whose unit count is below a share of the region's median count."""
    counts = units.groupBy(level1, level2).agg(F.count("*").alias("n"))
    medians = counts.groupBy(level1).agg(F.median("n").alias("med"))
    rare = counts.join(medians, level1).where(F.col("n") / F.col("med") < least_share)
    return units.join(rare.select(level1, level2), [level1, level2], "left_anti")


def select_units(units: DataFrame, listed: DataFrame | None = None, valid: list[str] = (), rare_share: float | None = 0.05, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """Units of a list, with every value of ``valid`` present, and not of rare subjects."""
    out = units if listed is None else units.join(listed.select(*keys).distinct(), list(keys), "left_semi")
    for c in valid:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    return out if rare_share is None else without_rare(out, rare_share)


def count_by(units: DataFrame, order: list[str], level1: str = "region", level2: str = "subject") -> DataFrame:
    """(region, subject, n, place): nested counts and the region's place in a given order."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in order]), F.col(level1)) - 1, F.lit(-1))
    return units.groupBy(level1, level2).agg(F.count("*").alias("n")).withColumn("place", place)


def region_centres(rows: DataFrame, conditions: list[str], n_boot: int, seed: str, time: str = "t", spread: str = "ci") -> DataFrame:
    """Nested means of each region over time with a bootstrap spread.

    ``rows`` has region, subject, unit, time and a column for each condition; all conditions
    and times share the draws.
    """
    stack = ", ".join(f"'{c}', {c}" for c in conditions)
    long = rows.select("region", "subject", "unit", time, F.expr(f"stack({len(conditions)}, {stack}) as (cond, value)")).where("value is not null")
    inner = long.groupBy("region", time, "cond", "subject").agg(F.avg("value").alias("s"), F.count("*").alias("n"))
    centre = inner.groupBy("region", time, "cond").agg(F.avg("s").alias("centre"), F.sum("n").alias("n_units"), F.count("*").alias("n_subjects"))
    boots = nested.hier_boots(long, n_boot, seed, extra=(time, "cond"))
    keys = ["region", time, "cond"]
    if spread != "ci":
        boots = boots.join(centre.select(*keys, F.col("centre").alias("at")), keys)
    return centre.join(nested.spread(boots, keys, spread, F.col("at")), keys)


def region_tests(rows: DataFrame, conditions: list[str], stat_tests: list[StatTest], n_perm: int, q: float, seed: str, time: str = "t") -> DataFrame:
    """Tests of each region over time, which flip the signs of the units' differences.

    p-values are clipped to their floor and corrected together over all regions, tests and times.
    """
    found = None
    for test in (t.ordered(conditions) for t in stat_tests):
        difference: Column = F.col(test.cond0) - F.col(test.cond1) if test.cond1 else F.col(test.cond0)
        part = rows.select("region", "subject", "unit", time, difference.alias("value"))
        part = nested.sign_flip_test(part, n_perm, f"{seed}-{test.name}", test.alternative, extra=(time,)).withColumn("test", F.lit(test.name))
        found = part if found is None else found.unionByName(part)
    return tests.fdr_two_stage(found.withColumn("p", F.greatest("p", "floor")).drop("floor"), q)


def summarize_regions(rows: DataFrame, conditions: list[str], stat_tests: list[StatTest], n_boot: int, n_perm: int, q: float, seed: str, time: str = "t", spread: str = "ci") -> tuple[DataFrame, DataFrame]:
    """(centres, tests) of each region over time, as ``region_centres`` and ``region_tests`` give them."""
    return region_centres(rows, conditions, n_boot, seed, time, spread), region_tests(rows, conditions, stat_tests, n_perm, q, seed, time)
