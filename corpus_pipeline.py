"""The corpus pipeline: five of the training-data operators in a row over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tessella.llm.common import materialize


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id and text for an operator, and the rest of the row in one column, so that no name of its columns clashes.

    The text isn't in it, so a shuffle of these rows moves it once.
    """
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_stage_row"))


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` from what an operator returns for ``_with_row(docs)``."""
    new = {"text": F.col("text"), **new}
    return [new.get(c, F.col("_stage_row")[c]).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to have quality 1, with all columns, whatever they are called.

    A text without words (null, empty, blank) scores the sample's share of label 1.  Rows that
    repeat a text are judged alike, and no row is joined, so repeats and rows without an id stay or go as they are.
    """
    scored = quality.score_quality(_with_row(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document with a smaller id has; n_chars follows.

    A null text becomes empty.  Rows that repeat an id are one document and keep their lines beside
    each other; rows without an id lose the lines that any id has.  Other columns are kept, whatever they are called.
    """
    out = line_dedup.dedup_lines(_with_row(docs))
    return out.select(*_columns(docs, n_chars=F.char_length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, and one row of it.

    Texts without words are linked with nothing and stay.  Of rows that repeat an id the one with the smallest
    text (null first) stays; rows without an id can't be named as copies and all stay.
    Further columns are kept, whatever they are called.
    """
    kept = near_dedup.dedup_near(_with_row(docs), one_row=True)
    return kept.select(*_columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with all columns, whatever they are called.

    Rows are judged one by one: null and empty texts stay, repeats stay or go together.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, with all columns, whatever they are called.

    Texts without words have size 0, which is taken as often as their source's rate says.  A null source is a source.
    Rows that repeat an id are taken equally often, rows without an id draw by their text.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source mix", mix),
]

#: The classifier can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
