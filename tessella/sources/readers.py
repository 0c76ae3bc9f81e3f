"""Scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import npy


def read_columns(spark: SparkSession, path: str, names: list[str], name: str = "unit") -> DataFrame:
    """Rows of the given units out of a Parquet array in long form; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(name).isin(names))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file, plain or compressed, with a header and a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a ragged TSV whose first name in a line is canonical; an alias of several lines has the smallest."""
    from tessella.operators.models import alias_map

    return alias_map(spark.read.text(path))


def read_sessions(spark: SparkSession, paths: list[str], config: DataFrame | None = None, done: str = "all_done") -> DataFrame:
    """The union by name of the sessions' files (partition column ``session``), complete ones only.

    ``config`` (session, key, value) marks a session as complete; columns that a file lacks are NULL.
    """
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        if "session" not in part.columns:
            part = part.withColumn("session", F.regexp_extract(F.input_file_name(), r"session=([^/]+)", 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if config is None:
        return out
    complete = config.where((F.col("key") == done) & (F.lower("value") == "true")).select("session").distinct()
    return out.join(complete, "session", "left_semi")


def read_arrays(spark: SparkSession, path: str, columns: list[int] | None = None, first_row: int | None = None, last_row: int | None = None) -> DataFrame:
    """(path, row, column, value) of .npy tables (a row of one dimension is row 0), plain or gzipped; 0 is left out, NaN is a row with NULL.

    ``path`` is a file, a folder or a pattern.  Plain files are read in byte ranges by many tasks,
    gzipped ones by one each.  Only cells of the given columns and rows (both ends included) are read.
    """
    npy.register(spark)
    options = {"first_row": first_row, "last_row": last_row, "columns": None if columns is None else ",".join(map(str, columns))}
    return spark.read.format("npy").options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_channels(spark: SparkSession, path: str, names: list[str], wanted: list[str]) -> DataFrame:
    """(path, row, name, value) of the wanted columns of .npy tables whose columns have the given names, in their order.

    A name that isn't there is an error, as is one that stands for two columns.
    """
    places = {n: i for i, n in enumerate(names)}
    if len(places) < len(names):
        raise ValueError("names of columns are repeated")
    missing = [n for n in wanted if n not in places]
    if missing:
        raise KeyError(f"no column {missing[0]}")
    asked = sorted({places[n] for n in wanted})
    known = spark.createDataFrame([(i, names[i]) for i in asked], "column long, name string")
    return read_arrays(spark, path, asked).join(F.broadcast(known), "column").select("path", "row", "name", "value")  # names that the caller lists


def decode_portable_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, width, height, channels, pixels) of binary PGM and PPM files, grey ones made RGB.

    Other formats need a decoder that isn't at hand here; pass pixels as a table instead.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                data = bytes(content)
                words, at = [], 0
                while len(words) < 4:
                    while data[at : at + 1].isspace():
                        at += 1
                    if data[at : at + 1] == b"#":
                        at = data.index(b"\n", at)
                        continue
                    end = at
                    while not data[end : end + 1].isspace():
                        end += 1
                    words.append(data[at:end])
                    at = end
                kind, width, height, _ = words[0], *map(int, words[1:])
                raw = np.frombuffer(data, np.uint8, width * height * (3 if kind == b"P6" else 1), at + 1)
                rgb = raw if kind == b"P6" else np.repeat(raw, 3)
                rows.append((name, width, height, 3, rgb.tobytes()))
            yield pd.DataFrame(rows, columns=["image", "width", "height", "channels", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "image string, width int, height int, channels int, pixels binary")


def consistent(tables: DataFrame, coordinate: str, keys: list[str] = ("session",)) -> DataFrame:
    """The coordinate's values, after checking that every file has the same ones; else the job fails."""
    files = tables.select(*keys).distinct().agg(F.count("*").alias("_files"))
    seen = tables.select(*keys, coordinate).distinct().groupBy(coordinate).agg(F.count("*").alias("_n"))
    met = seen.crossJoin(F.broadcast(files))  # one row
    return met.select(F.when(F.col("_n") == F.col("_files"), F.col(coordinate)).otherwise(F.raise_error(F.lit(f"{coordinate} differs between files"))).alias(coordinate))


def lookup_strict(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A many-to-one lookup in which a missing key fails the job."""
    marked = dimension.withColumn("_there", F.lit(True))
    met = rows.join(marked, key, "left")
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))))
    return met.withColumn(key, checked.cast(rows.schema[key].dataType)).drop("_there")
