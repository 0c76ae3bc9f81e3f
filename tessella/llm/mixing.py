"""Mixing sources to target weights.

Tokens are aggregated per source, a repetition rate is derived for each source, and
every document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import WORD_PATTERN, lookup_skewed, materialize

#: Above so many sources their rates are joined by a shuffle, which spreads hot sources, instead of a broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, from 0 in code-point order of the source, null last.

    Ranges of sources are numbered apart and shifted by the counts of the ranges
    before, so that no task sees more than its own range.
    """
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "mix-ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(before), "_part").withColumn("rank", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, cap: int = 2) -> DataFrame:
    """Per source: ``source``, ``source_size``, ``uses`` (its rows), ``target``, ``rate``.

    ``sized`` has ``source`` and ``size``.  The weights repeat over the sources by code
    point, null last.  The sources share ``budget_pct`` percent of all sizes by weight; a
    target stops at ``cap`` times its source's size, and the excess is shared again by
    weight among the others until none is above.  Sums are whole numbers, their products decimals of 38
    digits, so each target is one exact quotient at any size.  Without sizes every target and rate is 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("uses"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(_ranked(sizes).withColumn("weight", weight.cast("long")).drop("rank"), "mix-sources")
    number = lambda x: (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")
    sums = lambda *found: [int(v or 0) for v in table.agg(*[F.sum(number(f)) for f in found]).first()]
    (total, open_weight), capped = sums(F.col("source_size"), F.col("weight")), 0
    at_cap = F.lit(False)
    while True:  # each round caps at least one more source or is the last
        # the share of a unit of weight is (budget - capped) / open weight
        share_up, share_down = budget_pct * total - 100 * capped, 100 * open_weight
        if not share_down:
            break
        at_cap = number(F.col("weight")) * number(share_up) >= number(F.col("source_size")) * number(cap * share_down)
        found = sums(F.when(at_cap, number(F.col("source_size")) * cap), F.when(~at_cap, F.col("weight")))
        if found == [capped, open_weight] or not found[1]:
            break
        capped, open_weight = found
    shared = (number(F.col("weight")) * number(share_up)).cast("double") / F.lit(float(share_down or 1))
    target = F.when(at_cap, (number(F.col("source_size")) * cap).cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return table.withColumn("target", target).withColumn("rate", rate).drop("weight")


def coin(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    said = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, seed: str, *keys: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    whole = F.floor(rate)
    return whole + F.when(coin(seed, *keys) < rate - whole, 1).otherwise(0)


def _drawn_by(doc_id: Column, text: Column) -> Column:
    """What a document's coin depends on: its id, or without one its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _with_rates(rows: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's target; few sources are broadcast, many are looked up."""
    named = targets.withColumnRenamed("source", source)
    if targets.count() > BROADCAST_SOURCES:
        return lookup_skewed(rows, named, [source], "uses")
    met = rows.join(F.broadcast(named), rows[source].eqNullSafe(named[source]))
    return met.drop(named[source])


def plan_mix(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes).

    ``docs`` has doc_id, text and source; further columns are ignored.  A null text has
    size 0.  Null sources are one source of their own.  Equal doc_ids draw alike, so
    repeated rows are taken equally often; rows without a doc_id draw by their text.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("drawn")), "mix-sizes")
    out = _with_rates(sized, "source", source_targets(sized, **shares))
    by = F.coalesce(F.col("doc_id").cast("string"), F.col("drawn"))
    return out.withColumn("copies", copies(F.col("rate"), seed, by)).withColumn("taken", F.col("size") * F.col("copies")).drop("drawn", "uses")


def mix_sources(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it.

    The columns of ``docs`` are kept, whatever they are called.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, **shares).select(F.col("source"), "uses", F.col("rate").alias("_mix_rate"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), docs["source"].alias("_mix_source"))
    met = _with_rates(whole, "_mix_source", targets)
    times = copies(F.col("_mix_rate"), seed, _drawn_by(F.col("_mix_row")["doc_id"], F.col("_mix_row")["text"]))
    again = F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("_mix_copy")
    return met.where(times > 0).select("_mix_row", again).select("_mix_row.*")
