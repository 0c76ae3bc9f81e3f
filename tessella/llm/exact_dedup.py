"""Exact deduplication by a tree-merge of sorted digest runs.

Each leaf (a block of rows) makes a sorted run of digests.  In binomial rounds, groups of
``RADIX`` partners exchange runs by the next digits of the digest: every partner gets one
slice of the digests from all of them and merges the sorted slices into one run.  A run
so keeps about its size while its group grows, and after the last round each digest is in
one run.  Verdicts then go down the same tree, so no row of a frequent digest ever meets
more than ``RADIX`` others.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialize

RADIX_BITS = 4
RADIX = 1 << RADIX_BITS
#: Rows of a leaf at most.
LEAF_ROWS = 2048

_LEAF = "part int, block int, digest binary, length long, best long, n long, ids array<long>"
_LEAF_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("digest", pa.binary()), ("length", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])
_RUN = "group_id long, slice long, child long, digests array<binary>, lengths array<long>, bests array<long>, ns array<long>"
_MERGED = "level int, group_id long, slice long, digest binary, length long, best long, n long, mask int"


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaf runs: an entry for each digest of the leaf, with the ids that have it."""
    from pyspark import TaskContext

    part, block = TaskContext.get().partitionId(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, LEAF_ROWS):
            piece = batch.slice(start, LEAF_ROWS)
            found: dict[tuple[bytes, int], list] = {}
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                norm = (text or b"").lower()  # bytes.lower() changes A-Z only
                found.setdefault((hashlib.sha256(norm).digest(), len(norm)), []).append(doc_id)
            run = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(run), pa.int32()), pa.array([block] * len(run), pa.int32()),
                    pa.array([d for d, _ in run], pa.binary()), pa.array([n for _, n in run], pa.int64()),
                    pa.array([max((i for i in found[k] if i is not None), default=None) for k in run], pa.int64()),
                    pa.array([len(found[k]) for k in run], pa.int64()), pa.array([found[k] for k in run], pa.list_(pa.int64())),
                ],
                schema=_LEAF_ARROW,
            )
            block += 1


def _merge_runs(level: int):
    """Merges the sorted runs that one (group, slice) got from its partners.

    Digests that meet are verified by the length of what they stand for; the identifier
    that stays is the largest.
    """

    def merge(key, frame):
        import pandas as pd

        runs = [
            [((bytes(d), int(n)), b, c, int(child)) for d, n, b, c in zip(r.digests, r.lengths, r.bests, r.ns, strict=True)]
            for child, r in zip(frame.child, frame.itertuples(), strict=True)
        ]
        rows = []
        for (digest, length), met in groupby(heapq.merge(*runs, key=lambda e: e[0]), key=lambda e: e[0]):
            best, count, mask = None, 0, 0
            for _, b, c, child in met:
                best, count, mask = _larger(best, None if b is None or b != b else int(b)), count + int(c), mask | 1 << child
            rows.append((level, key[0], key[1], digest, length, best, count, mask))
        out = pd.DataFrame(rows, columns=["level", "group_id", "slice", "digest", "length", "best", "n", "mask"])
        return out.astype({"best": "Int64"})

    return merge


def _digit(level: int) -> F.Column:
    """The slice that a digest belongs to after so many rounds: its first digits."""
    return F.conv(F.substring(F.hex("digest"), 1, max(1, level)), 16, 10).cast("long") if level else F.lit(0).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.  Of
    equal texts the row with the largest id stays.  Rows with a null id count in
    ``group_size`` and never stay, unless the whole group has no id: then keep_id is null
    and kept is true for all.  Rows that repeat one id have the same verdict.
    """
    leaf = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_leaves, _LEAF), "exact-leaves")
    # leaves are numbered through, partition after partition
    blocks = leaf.groupBy("part").agg((F.max("block") + 1).alias("blocks"))  # a row for each partition
    first = blocks.select("part", (F.sum("blocks").over(Window.orderBy("part")) - F.col("blocks")).alias("first"))
    n_leaves = blocks.agg(F.sum("blocks")).first()[0] or 0
    leaf = leaf.join(F.broadcast(first), "part").withColumn("leaf", (F.col("first") + F.col("block")).cast("long"))

    rounds = 0
    while RADIX**rounds < n_leaves:
        rounds += 1
    runs = leaf.select(F.col("leaf").alias("group_id"), F.lit(0).cast("long").alias("slice"), "digest", "length", "best", "n")
    levels = []
    for level in range(1, rounds + 1):
        entry = F.sort_array(F.collect_list(F.struct("digest", "length", "best", "n")))
        sent = (
            runs.withColumn("child", F.col("group_id") % RADIX)
            .withColumn("group_id", (F.col("group_id") / RADIX).cast("long"))
            .withColumn("slice", _digit(level))
            .groupBy("group_id", "slice", "child")
            .agg(entry.alias("run"))
            .select("group_id", "slice", "child", F.col("run.digest").alias("digests"), F.col("run.length").alias("lengths"), F.col("run.best").alias("bests"), F.col("run.n").alias("ns"))
        )
        merged = materialize(sent.groupBy("group_id", "slice").applyInPandas(_merge_runs(level), _MERGED), f"exact-runs-{level}")
        levels.append(merged)
        runs = merged.select("group_id", "slice", "digest", "length", "best", "n")

    # down the tree: a verdict visits the partners whose runs held the digest
    verdict = runs.where("n > 1").select(F.col("group_id").alias("at"), "digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    for merged in reversed(levels):
        sent = verdict.join(merged.select(F.col("group_id").alias("at"), "digest", "mask"), ["at", "digest"])
        child = F.explode(F.expr(f"filter(sequence(0, {RADIX - 1}), i -> (shiftright(mask, i) & 1) = 1)"))
        verdict = sent.withColumn("child", child).select((F.col("at") * RADIX + F.col("child")).alias("at"), "digest", "keep_id", "group_size")
    entries = leaf.join(verdict.withColumnRenamed("at", "leaf"), ["leaf", "digest"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("best")).otherwise(F.col("keep_id"))
    rows = entries.select(F.explode("ids").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", "n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
