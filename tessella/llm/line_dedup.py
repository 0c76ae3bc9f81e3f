"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of ascending id.  A batch's distinct line hashes are
merge-joined with the runs of all batches before: what the runs hold was seen in a
smaller id, the rest (the anti-join) is new and is a run of its own.  When a level has
``FANOUT`` runs they are merged into one sorted run of the next level.

Runs are bucketed by their hashes into sorted files, of which the size of the texts gives
the number, so a batch is merged with them file by file: only the batch's own hashes are
shuffled, and a run is neither shuffled nor sorted when it is read.  The lines of a batch
are files of their own, so each is read with its batch alone.  DataFrame functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, ascii_lower, lookup_skewed, materialize, partitions, release, scratch_path, shuffle_partitions

FANOUT = 2
#: Text bytes of a batch, about; there are ``LEAST_BATCHES`` at least.
BATCH_BYTES, LEAST_BATCHES = 10_000_000_000_000, 3
#: Text bytes of which a bucket holds the keys, about; Spark makes no more than ``MOST_BUCKETS``.
BUCKET_BYTES, MOST_BUCKETS = 1_000_000_000, 100_000

#: Words of 64 bits that mark the documents that lose lines, broadcast: at most a row for each.
WORDS = 1 << 18

_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


@contextmanager
def _runs_in_order(spark: SparkSession) -> Iterator[None]:
    """Within, a bucket that is one sorted file is read as sorted rows."""
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ORDERED)
        else:
            spark.conf.set(_ORDERED, before)


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of sorted buckets in the shared folder; one file for each, if equal hashes share a partition."""
    spark = df.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    table = f"tessella_run_{uuid.uuid4().hex}"
    out = df.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, name))
    out.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
    read = spark.read.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame knows them
    return read


def _sorted_run(df: DataFrame, name: str) -> DataFrame:
    return _bucketed(df.repartition(F.col("h1"), F.col("h2")), name)


class LineRuns:
    """The levels of sorted runs: (h1, h2, first_id), each key in one run."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for k, other in enumerate(old[1:]):  # no key is in two runs, so the full join is their merge
                other = other.select("h1", "h2", F.col("first_id").alias(f"_other{k}"))
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("first_id", f"_other{k}").alias("first_id"))
            with _runs_in_order(run.sparkSession):
                merged = _bucketed(merged, f"line-run-{level + 1}")
            self.add(merged, level + 1)
            release(*old)

    def seen(self) -> DataFrame | None:
        """The keys of all runs, (h1, h2, first_id)."""
        runs = self.runs()
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def first_ids(self, found: DataFrame) -> DataFrame:
        """``found``, whose (h1, h2) are unique, with the first_id of the run that holds the key, null where none does."""
        firsts = [F.lit(None).cast("long")]
        for k, run in enumerate(self.runs()):
            found = found.join(run.select("h1", "h2", F.col("first_id").alias(f"_run{k}")).hint("merge"), ["h1", "h2"], "left")
            firsts.append(F.col(f"_run{k}"))
        return found.withColumn("first_id", F.coalesce(*firsts)).drop(*[f"_run{k}" for k in range(len(firsts) - 1)])

    def release(self) -> None:
        release(*self.runs())
        self.levels = []


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text_hash, _dropped): for each document that loses lines, the line numbers from 0.

    Documents are told apart by id and text, so rows that repeat both share one entry.
    Without ``batches`` there are as many as ``BATCH_BYTES`` asks for.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    with shuffle_partitions(spark, min(partitions(spark, n_bytes, BUCKET_BYTES), MOST_BUCKETS)):
        return _dropped_lines(docs, min_chars, batches or max(LEAST_BATCHES, n_bytes // BATCH_BYTES + 1), id_col, text_col)


def _dropped_lines(docs: DataFrame, min_chars: int, batches: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(id_col, [b / batches for b in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    # ids that are null come last
    batch_of = F.when(F.col("_id").isNull(), len(cuts)).otherwise(sum((F.col("_id") > c).cast("int") for c in cuts) if cuts else 0)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keys = F.posexplode(F.split(ascii_lower("_text"), "\n", -1)).alias("_pos", "_line")
    key = F.btrim("_line", F.lit(SPACE))
    lines = (
        base.select("_id", F.xxhash64("_text").alias("_text_hash"), keys)
        .select("_id", "_text_hash", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_text_hash", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("h2"), batch_of.cast("int").alias("_batch"))
    )
    lines = materialize(lines, "lines", by="_batch")  # 16 bytes of hash for a line, so the texts are split once
    runs, out = LineRuns(), []
    for number in range(len(cuts) + 1):
        batch = lines.where(F.col("_batch") == number).drop("_batch")
        found = batch.groupBy("h1", "h2").agg(F.min("_id").alias("own_id"), F.max("_id").alias("last_id"), F.count("*").alias("uses"), F.count_if(F.col("_id").isNull()).alias("unnamed"))
        with _runs_in_order(spark):
            merged = _bucketed(runs.first_ids(found), "line-batch")
        repeated = merged.select("h1", "h2", F.coalesce("first_id", "own_id").alias("first_id"), "last_id", "uses", "unnamed").where("first_id < last_id or (first_id is not null and unnamed > 0)")
        met = lookup_skewed(batch, repeated, ["h1", "h2"], "uses").where("first_id is not null and (_id is null or first_id < _id)")
        out.append(materialize(met.groupBy("_id", "_text_hash").agg(F.collect_set("_pos").alias("_dropped")), "line-dropped"))
        if number == len(cuts):  # nothing comes after the last batch
            release(merged)
        else:  # the batch's table, without what the runs hold, is a run
            runs.add(merged.where("first_id is null and own_id is not null").select("h1", "h2", F.col("own_id").alias("first_id")))
    runs.release()
    release(lines)
    dropped = out[0]
    for more in out[1:]:
        dropped = dropped.unionByName(more)
    return dropped


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of the lines that stay, and ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of
    ``min_chars`` code points or more lose their lines in every document but that with the
    smallest id.  A null or empty text is one empty line and becomes "".  Rows with a null
    id come after all ids and never hold a line back from others; rows that repeat an id
    are one document as far as keys are concerned.  Other columns are kept; n_lines and
    n_dropped of the input are replaced.
    """
    found = dropped_lines(docs, min_chars, batches, id_col, text_col)
    dropped = found.select(*[F.col(c).alias(f"_line_dedup{c}") for c in found.columns])
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(dropped["_line_dedup_id"]) & (F.xxhash64(text) == dropped["_line_dedup_text_hash"])
    lines, gone = F.split(text, "\n", -1), F.col("_line_dedup_dropped")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))

    def counted(df: DataFrame, kept: Column, n_dropped: Column) -> DataFrame:
        out = [kept.alias(c) if c == text_col else docs[c] for c in columns]
        return df.select(*out, F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))

    losers, others = _split_by_marks(docs, dropped, docs[id_col], F.xxhash64(text))
    met = counted(losers.join(dropped, same, "left"), kept, F.coalesce(F.size(gone), F.lit(0)))
    return met.union(counted(others, text, F.lit(0)))


def _split_by_marks(docs: DataFrame, dropped: DataFrame, id_: Column, text_hash: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may be in ``dropped``, and others, which aren't and so needn't be shuffled to meet it.

    Each document that loses lines sets one of ``64 * WORDS`` bits; a row with a bit that another one set is among the first.
    """

    def place(id_: Column, text_hash: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.lit(2), id_, text_hash)
        return F.pmod(h, F.lit(WORDS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")

    word, bit = place(F.col("_line_dedup_id"), F.col("_line_dedup_text_hash"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = dropped.select(word.alias("_line_dedup_word"), one.alias("_line_dedup_bits")).groupBy("_line_dedup_word").agg(F.bit_or("_line_dedup_bits").alias("_line_dedup_bits"))
    marks = materialize(marks, "line-marks")
    word, bit = place(id_, text_hash)
    marked = docs.join(F.broadcast(marks), word == marks["_line_dedup_word"], "left")
    may = F.coalesce(F.getbit(marks["_line_dedup_bits"], bit), F.lit(0)) == 1
    return marked.where(may), marked.where(~may)
