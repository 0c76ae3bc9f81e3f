"""Unit hierarchies: names, first hits, and cascades of imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import bank_of, first_integer, level_of


def annotate_units(units: DataFrame, banks: DataFrame, name: str = "name", session: str = "session") -> DataFrame:
    """channel, bank and subject from a unit's names, and the columns of its bank (left join on session and bank)."""
    channel = first_integer(F.col(name))
    named = units.withColumn("channel", channel).withColumn("bank", bank_of(channel)).withColumn("subject", F.substring(session, 1, 2))
    return named.join(banks, [session, "bank"], "left")


def annotate_names(names: DataFrame, units: DataFrame, levels: dict[str, str], name: str = "name") -> DataFrame:
    """Columns of the hierarchy for names "Level/rest" of any level: {level: column of ``units``}.

    What lies below a name's own level is NULL.
    """
    rest = F.regexp_replace(name, r"^[^/]*/", "")
    order = list(levels)
    out = None
    for i, level in enumerate(order):
        above = [levels[x] for x in order[i:]]
        known = units.select(*above).distinct()
        part = names.where(level_of(F.col(name)) == level).withColumn(levels[level], rest)
        part = part.join(known.dropDuplicates([levels[level]]), levels[level], "left")
        for x in order[:i]:
            part = part.withColumn(levels[x], F.lit(None).cast("string"))
        part = part.select(*names.columns, *levels.values())
        out = part if out is None else out.unionByName(part)
    return out


def first_hit(units: DataFrame, known: DataFrame, levels: list[tuple[str, Column]], unit: str = "unit") -> DataFrame:
    """(unit, level, key, and the columns of ``known``): the first level at which a unit's key is known.

    ``levels`` are (level, key of the unit) from the finest; ``known`` has level and key.  A
    unit without a hit is dropped.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(level).alias("level"), key.cast("string").alias("key")) for i, (level, key) in enumerate(levels)])
    long = units.select(unit, F.explode(steps).alias("s")).select(unit, "s.*").where("key is not null")
    met = long.join(known, ["level", "key"])
    rest = [c for c in known.columns if c not in ("level", "key")]
    best = met.groupBy(unit).agg(F.min_by(F.struct("level", "key", *rest), "rank").alias("h"))
    return best.select(unit, "h.*")


def on_grid(x: Column, step: float) -> Column:
    return F.rint(x / step) * step


def cascade(units: DataFrame, tables: list[tuple[str, DataFrame, list[str]]], values: list[str], default: dict[str, float], source: str = "source") -> DataFrame:
    """Values from the first of several tables that has them, else the default, and which it was.

    ``tables`` are (name, table, keys); each has one row for each of its keys.
    """
    out, found = units, F.lit(None)
    for name, table, keys in tables:
        columns = {v: f"_{name}_{v}" for v in values}
        out = out.join(table.select(*keys, *[F.col(v).alias(c) for v, c in columns.items()]), keys, "left")
    hit = lambda name: F.col(f"_{name}_{values[0]}").isNotNull()
    picked = {}
    for v in values:
        found = F.lit(float(default[v]))
        for name, _, _ in reversed(tables):
            found = F.when(hit(name), F.col(f"_{name}_{v}")).otherwise(found)
        picked[v] = found
    origin = F.lit("default")
    for name, _, _ in reversed(tables):
        origin = F.when(hit(name), F.lit(name)).otherwise(origin)
    return out.select(*units.columns, *[c.alias(v) for v, c in picked.items()], origin.alias(source))


def impute(units: DataFrame, measured: DataFrame, values: list[str], step: float, default: dict[str, float], levels: tuple[str, ...] = ("unit", "channel", "array_id"), session: str = "session", shared: str = "array_id") -> DataFrame:
    """Each unit's values: medians of what is measured at its own name, its channel, its array in the session,
    its array in any session, else the default; medians are taken after rounding to the grid.

    ``measured`` has session, level, key and the values; ``units`` has session and a column for each level.
    """
    grid = measured.select(session, "level", "key", *[on_grid(F.col(v), step).alias(v) for v in values])
    tables = []
    for level in levels:
        t = grid.where(F.col("level") == level).groupBy(session, F.col("key").alias(level)).agg(*[F.median(v).alias(v) for v in values])
        tables.append((level, t, [session, level]))
    anywhere = grid.where(F.col("level") == shared).groupBy(F.col("key").alias(shared)).agg(*[F.median(v).alias(v) for v in values])
    return cascade(units, [*tables, ("any_session", anywhere, [shared])], values, default)
